import pytest
from pyspark.sql import functions as F

from factmill.functions import descriptors, ids, insights, locations, names, values


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("name", "expected"),
    [("int", "I"), ("int[]", "[I"), ("long...", "[J"), ("java.util.List<String>", "Ljava/util/List;"), ("a.B$C[][]", "[[La/B$C;"), ("", "Ljava/lang/Object;"), (None, "Ljava/lang/Object;"), ("[[int", "[[I")],
)
def test_descriptor(spark, name, expected):
    assert one(spark, descriptors.descriptor(F.lit(name).cast("string"))) == expected


@pytest.mark.parametrize(
    ("value", "loose", "strict"),
    [("()V", True, True), ("(I[JLa/b;)V", True, True), ("([)V", True, False), ("(L;)V", True, False), ("(V)V", False, False), ("I", False, False), ("()L;", False, False), ("()[[D", True, True), (None, False, False)],
)
def test_signature_grammar(spark, value, loose, strict):
    column = F.lit(value).cast("string")
    assert one(spark, descriptors.is_method_descriptor(column)) is loose
    assert one(spark, descriptors.is_method_descriptor(column, strict=True)) is strict


def test_ids(spark):
    a = F.lit
    assert one(spark, ids.executable_id(a("java"), a("p.C.m"), a("()V"))) == "java:p.C.m#()V"
    assert one(spark, ids.parameter_id(a("x"), a(1))) == "x.param(1)"
    assert one(spark, ids.position_id(a("cpp"), a("f.c"), a(3), a(4))) == "cpp:f.c:3:4"
    assert one(spark, ids.relation_id(a("s"), a("CALLS"), a(""), a(3), a(4), a(0))) == "s:CALLS:ext@3:4"
    assert one(spark, ids.relation_id(a("s"), a("CALLS"), a("t"), a(3), a(4), a(2))) == "s:CALLS:t@3:4#2"


@pytest.mark.parametrize(("line", "col", "inside"), [(2, 4, False), (2, 5, True), (3, 1, True), (4, 7, True), (4, 8, False), (5, 1, False)])
def test_half_open_interval(spark, line, col, inside):
    assert one(spark, locations.contains(*map(F.lit, (2, 5, 4, 8, line, col)))) is inside


def test_names(spark):
    a = F.lit
    assert one(spark, names.short_name(a("java:p.C.m#(I)V"))) == "m"
    assert one(spark, names.short_name(a(""))) == "external"
    assert one(spark, names.node_name(a("java:p.C.<init>#()V"))) == "_init_"
    assert one(spark, names.file_name(a("a/b\\c.h"))) == "c.h"
    assert one(spark, names.relativize(a("/r/a/b"), a("/r"))) == "a/b"
    assert one(spark, names.file_key(a("p:a:b")))["path"] == "a:b"
    assert one(spark, names.file_key(a(":a"))) is None
    assert one(spark, names.qualify(a("D"), a("p.q.C"))) == "p.q.D"
    assert one(spark, names.is_ignored(a("a/.git/x"))) and one(spark, names.is_ignored(a("build/x"))) and not one(spark, names.is_ignored(a("src/builder/x")))
    assert one(spark, names.is_source(a("X.JAVA"), "java")) and not one(spark, names.is_source(a("x.py"), "java"))
    assert one(spark, names.duration_text(a(999))) == "999ms" and one(spark, names.duration_text(a(1500))) == "1.5s"
    assert one(spark, names.backoff_millis(a(300), a(3))) == 1200 and one(spark, names.backoff_millis(a(300), a(40))) == 15000
    assert one(spark, names.chat_url(a("http://h/v1/"))) == "http://h/v1/chat/completions"
    assert one(spark, names.macro_parameters(a("MAX(a, (b))"))) == "a, (b)"
    assert one(spark, names.template("x${a}y${b}", a=a(1), b=a(None))) == "x1y"


def test_values(spark):
    assert one(spark, values.one_of(F.lit("odd"), ("a", "b"), "a")) == "a"
    assert one(spark, values.clamp(F.lit(9), 1, 5)) == 5
    assert one(spark, values.parsed(F.lit("{bad"), "a int"))["a"] is None


def test_priority(spark):
    a = F.lit
    assert one(spark, insights.priority(a("Class"), a(" "), a(None).cast("string"), F.array(a("public"), a("abstract")))) == 200 + 80 + 50 + 40
    assert one(spark, insights.priority(a("Method"), a("doc"), a("x" * 600), a(None).cast("array<string>"))) == 20 + 100


@pytest.mark.parametrize(("answer", "expected"), [('{"confidence": 0.4}', 0.4), ('{"confidence": 80}', 0.8), ('{"severityScore": -2}', 0.0), ('{"confidence": "high"}', 0.6), ("none", 0.6)])
def test_confidence(spark, answer, expected):
    assert one(spark, insights.confidence(F.lit(answer))) == pytest.approx(expected)


def test_evidence_is_an_ordered_union(spark):
    answer = '{"evidence": ["a", "b"], "upstream": ["b"], "issues": [{"evidence": ["c", "a"]}, {}]}'
    assert one(spark, insights.evidence(F.lit(answer), F.lit("d"))) == ["a", "b", "c"]
    assert one(spark, insights.evidence(F.lit("{}"), F.lit("d"))) == ["d"]


def test_structured_answer(spark):
    a = F.lit
    read = lambda text, kind: one(spark, insights.structured(a(text), a(kind), a("id"), a("q")))
    assert read('```json\n{"note": "n"}\n```', "summary") == {"note": "n", "summary": "n", "evidence": '["id"]'}
    assert read('{"x": "1"}', "arch_role")["role"] == "unknown"
    assert read("", "summary")["fallback"] == "true"
    assert read("no json", "summary")["raw"] == "no json"
