"""C++: conditionals, members of templates, pointers to functions and plain reads; and where sources are looked for."""

from factmill.sources import files as source_files
from factmill.sources.cpp import CppConfig, parse_cpp

TEXT = """#ifndef GUARD_H
#define GUARD_H
#define LEVEL 3
#if 0
void never() { {
#endif
#ifdef DEBUG
void debug() {
#else
void release() {
#endif
    counter = 1;
}
#if LEVEL >= 2 && !defined(SMALL)
void large() { }
#elif LEVEL
void small() { }
#else
void none() { }
#endif
#if __has_include(<x>)
void unknown() { }
#endif
int counter;
template <typename T> struct V { T get(); void (*cb)(int); T held; };
template <typename T> T V<T>::get() { return held; }
template <typename T> T outer::W<T>::get() { return counter; }
int after() { int local = 2; return local + counter; }
#endif
"""


def _parsed(**config):
    return parse_cpp("a.cpp", TEXT, CppConfig(**config))


def test_branches_that_hold():
    names = lambda facts: {e["name"] for e in facts.entities if e["type"] == "Function"}
    facts = _parsed()
    assert names(facts) == {"release", "large", "unknown", "after"} and not [i for i in facts.issues if i["code"] == "CPP.DIAGNOSTIC"]
    assert names(_parsed(defines=("DEBUG", "SMALL=1"))) == {"debug", "small", "unknown", "after"}
    assert "GUARD_H" in {e["name"] for e in facts.entities if e["type"] == "Macro"}


def test_members_of_templates_and_pointers():
    facts = _parsed()
    ids = {e["id"]: e for e in facts.entities}
    assert any(i.startswith("cpp:V::get#") for i in ids) and any(i.startswith("cpp:outer::W::get#") for i in ids) and not any(":>" in i for i in ids)
    assert ids["cpp:V::cb"]["type"] == "Field" and "cpp:counter" in ids


def test_plain_reads():
    reads = {(r["source_id"].split("#")[0], r["owner"], r["name"]) for r in _parsed().references if r["type"] == "REFERENCES" and r["owner"] != "="}
    assert ("cpp:after", "", "counter") in reads and ("cpp:V::get", "V", "held") in reads and ("cpp:outer::W::get", "", "counter") in reads
    assert not any(name == "local" for _, _, name in reads)


def test_source_roots(spark, tmp_path):
    files = lambda *paths: spark.createDataFrame([(p,) for p in paths], "path string")
    roots = lambda *args: [r.root for r in source_files.source_roots(*args).orderBy("place").collect()]
    own = spark.createDataFrame([(0, "lib"), (1, ""), (2, "src"), (3, "lib")], "place int, root string")
    assert roots(files("src/main/java/a/A.java", "java/B.java")) == ["src/main/java", "src", "java"]
    assert roots(files("src/a/A.java"), own) == ["lib", "src"]
    assert roots(files("code/a/A.java", "B.java")) == ["code"] and roots(files("B.java")) == [""] and roots(files()) == [""]
    (tmp_path / "target/classes").mkdir(parents=True)
    assert source_files.class_path(spark, str(tmp_path), "Maven", ("x", "", "x")) == [f"{tmp_path}/target/classes", f"{tmp_path}/x"]
    assert source_files.class_path(spark, str(tmp_path), "gradle") == []
