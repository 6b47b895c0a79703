import pytest
from pyspark.sql import functions as F

from factmill.operators.resolve import overrides, resolve, virtual_calls
from factmill.plans.runs import Project, extract, run
from factmill.sources import files as source_files
from factmill.sources.cpp import CppConfig, allowed, compile_flags, parse_cpp
from factmill.sources.facts import Facts, parse
from factmill.sources.java import parse_java
from factmill.sources.store import Store

BASE = """package shop;
/** A thing that is sold. */
public abstract class Base implements Sale {
    protected int stock;
    public void sell(int n) { stock = stock - n; }
    public void log(String text) { }
}
"""
SALE = "package shop;\npublic interface Sale { void sell(int n); }\n"
BOOK = """package shop;
import java.util.List;
public class Book extends Base {
    private List<String> tags;
    public Book(List<String> tags) { this.tags = tags; }
    @Override
    public void sell(int n) {
        log("sold");
        Book other = new Book(tags);
        other.sell(1); other.sell(2);
        if (n > this.stock) { throw new IllegalStateException("x"); }
        System.out.println(n);
    }
    enum Kind { NOVEL, COMIC(3); int pages; }
}
"""
FILES = [("shop/Base.java", BASE), ("shop/Sale.java", SALE), ("shop/Book.java", BOOK)]


@pytest.fixture(scope="module")
def facts(spark):
    return extract(source_files.imported(spark, FILES), Project("p"))


def _ids(df, kind):
    return sorted(r.id for r in df.filter(F.col("type") == kind).collect())


def test_java_entities(facts):
    entities = facts[0]
    assert _ids(entities, "Class") == ["java:shop.Base", "java:shop.Book"]
    assert _ids(entities, "Method") == ["java:shop.Base.log#(Ljava/lang/String;)V", "java:shop.Base.sell#(I)V", "java:shop.Book.sell#(I)V", "java:shop.Sale.sell#(I)V"]
    assert _ids(entities, "Constructor") == ["java:shop.Book.<init>#(Ljava/util/List;)V"]
    assert _ids(entities, "EnumConstant") == ["java:shop.Book$Kind.COMIC", "java:shop.Book$Kind.NOVEL"]
    assert _ids(entities, "Field") == ["java:shop.Base.stock", "java:shop.Book$Kind.pages", "java:shop.Book.tags"]
    contained = facts[1].filter("type = 'CONTAINS'").select("target_id")
    assert contained.count() == contained.distinct().count() == entities.filter("type <> 'File'").count()


def test_java_relations_do_not_depend_on_file_order(facts, spark):
    rows = {(r.type, r.source_id.split(".")[-1], r.target_id or r.external_target) for r in facts[1].filter("type <> 'CONTAINS'").collect()}
    sell = "sell#(I)V"
    assert ("INHERITS", "Book", "java:shop.Base") in rows
    assert ("IMPLEMENTS", "Base", "java:shop.Sale") in rows
    assert ("OVERRIDES", sell, "java:shop.Base.sell#(I)V") in rows and ("OVERRIDES", sell, "java:shop.Sale.sell#(I)V") in rows
    assert ("CALLS", sell, "java:shop.Base.log#(Ljava/lang/String;)V") in rows
    assert ("CALLS", sell, "java:shop.Book.sell#(I)V") in rows
    assert ("INSTANTIATES", sell, "java:shop.Book.<init>#(Ljava/util/List;)V") in rows
    assert ("THROWS", sell, "java.lang.IllegalStateException") in rows
    assert ("READS", sell, "java:shop.Base.stock") in rows
    assert ("WRITES", "<init>#(Ljava/util/List;)V", "java:shop.Book.tags") in rows
    assert ("DEPENDS_ON", "java", "java.util.List") in rows
    again = extract(source_files.imported(spark, FILES[::-1]), Project("p"))
    for a, b in zip(facts[:2], again[:2], strict=True):
        assert sorted(r.id for r in a.select("id").collect()) == sorted(r.id for r in b.select("id").collect())


def test_same_place_relations_are_numbered(spark):
    text = "class A { void f() { a().b(); a().b(); } }"
    entities, references, _, _ = parse(source_files.imported(spark, [("A.java", text)]), parse_java, "X")
    found = resolve(entities, references.unionByName(references.filter("type = 'CALLS'").withColumn("argument", F.lit(1))))
    calls = [r.id for r in found.filter("type = 'CALLS'").collect()]
    assert len(calls) == len(set(calls)) == 8 and sum("#1" in c for c in calls) == 4
    assert overrides(entities, found).count() == 0


def test_members_are_inherited_over_many_levels(spark):
    made = [("C0.java", "class C0 extends C1 { void f() { far(1); this.stock = 2; } }")]
    made += [(f"C{i}.java", f"class C{i} extends C{i + 1} {{ }}") for i in range(1, 7)]
    made += [("C7.java", "class C7 extends C5 { int stock; void far(int x) { } }")]  # on a cycle
    entities, references, _, _ = parse(source_files.imported(spark, made), parse_java, "X")
    held = lambda **depth: {(r.type, r.target_id) for r in resolve(entities, references, **depth).filter("source_id like '%.f#%' or source_id like '%C0.f%'").collect()}
    got = held()
    assert ("CALLS", "java:C7.far#(I)V") in got and ("WRITES", "java:C7.stock") in got
    assert not {("CALLS", "java:C7.far#(I)V"), ("WRITES", "java:C7.stock")} & held(depth=4)


def test_broken_file_is_one_issue(spark):
    def bad(path, text):
        if "bad" in path:
            raise ValueError("no")
        return parse_java(path, text)

    entities, _, issues, times = parse(source_files.imported(spark, [("bad.java", "x"), ("A.java", "class A {"), ("gone.java", None)]), bad, "JAVA.PARSE_FAILED")
    assert [r.file for r in entities.filter("type = 'File'").collect()] == ["A.java"]
    assert sorted(r.code for r in issues.collect()) == ["JAVA.PARSE_FAILED", "JAVA.SYNTAX"]
    assert times.count() == 2


CPP = """#include "bank.h"
#define LIMIT 100
namespace bank {
template <typename T> T pick(T a, int n) { return a; }
template int pick<int>(int, int);
class Account : public Entity {
public:
    Account(const std::string& owner);
    virtual ~Account();
    double total() const { return total_ + LIMIT; }
private:
    double total_;
};
Account::Account(const std::string& owner) { audit(owner); Account* o = new Account(owner); }
void audit(const std::string& who) { }
}
"""


def test_cpp():
    facts = parse_cpp("bank.cpp", CPP)
    ids = {e["id"]: e["type"] for e in facts.entities}
    assert ids["cpp:bank::Account"] == "Class" and ids["cpp:bank::Account::~Account#() -> void"] == "Destructor"
    assert ids["cpp:bank::Account::total#() -> double const"] == "Method" and ids["cpp:bank::Account::total_"] == "Field"
    assert ids["cpp:bank::pick#template<T#0> (T#0, int) -> T#0"] == "Function"
    assert ids["cpp:bank::audit#(const ::std::string &) -> void"] == "Function"
    assert ids["cpp:bank.cpp:2:1"] == "Macro"
    refs = {(r["type"], r["name"]) for r in facts.references}
    assert {("DEPENDS_ON", "bank.h"), ("INHERITS", "Entity"), ("CALLS", "audit"), ("INSTANTIATES", "Account"), ("REFERENCES", "cpp:bank.cpp:2:1")} <= refs
    assert next(r for r in facts.references if r["type"] == "REFERENCES")["source_id"].startswith("cpp:bank::Account::total#")
    assert [i["code"] for i in facts.issues] == ["CPP.TEMPLATE_INSTANTIATION_SKIPPED"]
    assert ("INSTANTIATES", "pick") in {(r["type"], r["name"]) for r in parse_cpp("bank.cpp", CPP, CppConfig(policy="full")).references}


def test_cpp_policy_and_flags():
    config = CppConfig(policy="whitelist", whitelist=("std::vector",), include_dirs=("inc",), defines=("X=1",))
    assert allowed(config, "std::vector<int>") and allowed(config, "std::vector") and not allowed(config, "std::vectors")
    assert compile_flags(config, "a.h") == ["-x", "c++", "-std=c++17", "-Iinc", "-DX=1"]
    assert compile_flags(config, "a.cpp", ["cc", "-O2", "-c", "src/a.cpp", "-o", "a.o"]) == ["-O2"]


def test_scan(spark, tmp_path):
    for path, data in {"a/A.java": b"class A {}", ".git/B.java": b"x", "build/C.java": b"x", "D.java": b"\xff\xfe", "e.txt": b"x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    rows = {r.path: r for r in source_files.scan(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a/A.java", "D.java"}
    assert rows["D.java"].issue == "FILE.ENCODING" and rows["D.java"].content is None and rows["a/A.java"].content == "class A {}"


def test_compile_database_and_answers(spark, tmp_path):
    (tmp_path / "db.json").write_text('[{"file": "/w/src/a.cpp", "directory": "/w", "arguments": ["cc", "-O2", "-c", "src/a.cpp", "-o", "x"]}, {"file": "b.cpp", "command": "cc b.cpp"}]')
    files = spark.createDataFrame([("src/a.cpp",), ("c.cpp",)], "path string")
    found = source_files.compile_commands(spark, str(tmp_path / "db.json"), files)
    assert [r.a for r in found.select(source_files.clean_arguments(F.col("arguments"), F.col("path")).alias("a")).collect()] == [["-O2"]]
    answer = '{"files": [{"path": "a", "entities": [{"id": "1", "odd": 2}], "relations": [], "issues": [{"code": "C"}]}]}'
    entities, relations, issues = source_files.response_tables(spark.createDataFrame([(answer,)], "json string"))
    assert entities.first().id == "1" and relations.count() == 0 and issues.first().code == "C"


def test_runs_are_incremental(spark, tmp_path):
    store, project = Store(spark, str(tmp_path)), Project("p", permissive=True, ratio=0.9)
    first = run(spark, store, project, source_files.imported(spark, FILES))
    assert {r.reason for r in first.plan.collect()} == {"full"} and first.events[-1] == ("run_completed", "run")
    assert "# p" in first.document.first().content
    whole = sorted(r.id for r in store.read("entities").select("id").collect())
    same = run(spark, store, project, source_files.imported(spark, FILES), stages=("parse",))
    assert same.plan.count() == 0 and sorted(r.id for r in store.read("entities").select("id").collect()) == whole
    changed = [FILES[0], FILES[1], (FILES[2][0], BOOK.replace("COMIC(3)", "COMIC(3), POEM"))]
    run(spark, store, project, source_files.imported(spark, changed))
    fresh = Store(spark, str(tmp_path / "other"))
    run(spark, fresh, project, source_files.imported(spark, changed))
    for name in ("entities", "relations"):
        assert sorted(r.id for r in store.read(name).select("id").collect()) == sorted(r.id for r in fresh.read(name).select("id").collect())
    store.vacuum()
    assert len(store.versions()) == 1 and store.read("entities").count() == len(whole) + 1
    with pytest.raises(ValueError, match="archived"):
        run(spark, store, Project("p", archived=True), source_files.imported(spark, FILES))


SHAPES = """namespace geo {
class Shape { public: virtual double area(int n); int plain(); };
class Box : public geo::Shape { public: double both(Shape &other) { this->plain2(); other.area(1); part_->plain(); Shape *s = part_; s->area(2); unknown.area(3); return 0; }
  void plain2(); Shape *part_; };
}
"""


def test_calls_on_objects_in_cpp(spark):
    files = spark.createDataFrame([("shapes.cpp", SHAPES)], "path string, content string")
    entities, relations, _ = extract(files, Project("p", "cpp"))
    got = {(r.location.start_col, r.target_id, r.external_target, r.virtual) for r in virtual_calls(relations, entities).filter("type = 'CALLS'").collect()}
    named = sorted((t or x, v) for _, t, x, v in got)
    area, plain = "cpp:geo::Shape::area#(int) -> double", "cpp:geo::Shape::plain#() -> int"
    assert named == sorted([(area, True), (area, True), (plain, False), ("cpp:geo::Box::plain2#() -> void", False), ("area", None)])


def test_a_file_that_takes_too_long_is_an_issue(spark):
    def endless(path, text):
        while text == "loop":
            pass
        return Facts(path, "X")

    files = spark.createDataFrame([("a", "loop"), ("b", "fine")], "path string, content string")
    *_, issues, millis = parse(files, endless, "X.FAILED", seconds=1)
    assert [(r.code, r.file) for r in issues.collect()] == [("X.FAILED", "a")] and millis.count() == 2


def test_commits_after_vacuum_are_seen(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for n in range(1, 5):
        store.commit(t=spark.range(n))
    store.vacuum(1)
    store.commit(t=spark.range(100))
    assert store.read("t").count() == 100 and len(store.versions()) == 2
    store.append(t=spark.range(5), u=spark.range(2))
    store.append(u=spark.range(3))
    store.vacuum(1)
    assert store.read("t").count() == 105 and store.read("u").count() == 5


VIRTUAL = """class A { public: virtual int late(); int plain(); };
class B : public A { public: int late(); int plain(); };
class C : public B { public: int late() override; int plain(); };
int use(B &b, C &c) { b.late(); b.plain(); return c.late(); }
"""


def test_cpp_overrides_only_what_is_virtual(spark):
    files = spark.createDataFrame([("v.cpp", VIRTUAL)], "path string, content string")
    entities, relations, _ = extract(files, Project("p", "cpp"))
    over = {(r.source_id, r.target_id) for r in relations.filter("type = 'OVERRIDES'").collect()}
    name = lambda c: f"cpp:{c}::late#() -> int"
    assert over == {(name("B"), name("A")), (name("C"), name("B"))}
    calls = {r.target_id: r.virtual for r in virtual_calls(relations, entities).filter("type = 'CALLS'").collect()}
    assert calls == {name("B"): True, name("C"): True, "cpp:B::plain#() -> int": False}


def test_methods_of_object_are_overridden_outside(spark):
    text = "class A { public String toString() { return null; } public boolean equals(A other) { int x = 1; x = 2; return true; } }\ninterface I { int hashCode(); }"
    _, relations, _ = extract(spark.createDataFrame([("A.java", text)], "path string, content string"), Project("p"))
    assert [r.external_target for r in relations.filter("type = 'OVERRIDES'").collect()] == ["java.lang.Object.toString#()Ljava/lang/String;"]
    assert [r.external_target for r in relations.filter("type = 'WRITES'").collect()] == ["A.x"]  # the assignment, not the declaration
