"""Checksums, scores and the reading of structured answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of entity types, and the versions and confidence that hold by default.
TYPE_WEIGHTS = {200: ("Class", "Interface", "Enum"), 20: ("Method", "Constructor"), 2: ("Field",)}
DEFAULT_CONFIDENCE = 0.6
REQUIRED = {
    "summary": {"summary": None, "evidence": "[id]"},
    "tech_debt": {"issues": "[]", "summary": ""},
    "arch_role": {"role": "unknown", "upstream": "[]", "downstream": "[]"},
    "business_rule": {"rules": "[]", "evidence": "[]"},
}


def code_checksum(qualified_name: Column, signature: Column, path: Column, start_line: Column) -> Column:
    """The first 16 hex digits of a hash of what identifies an entity."""
    place = F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.coalesce(start_line.cast("string"), F.lit("")))
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(qualified_name, F.lit("")), F.coalesce(signature, F.lit("")), place), 256), 1, 16)


def slice_checksum(content: Column, start_line: Column, end_line: Column) -> Column:
    """The same length of a hash of the entity's own lines, so that an edit of its body shows."""
    lines = F.slice(F.split(content, "\n"), F.greatest(start_line, F.lit(1)), F.greatest(end_line - start_line, F.lit(1)))
    return F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16)


def cache_key(entity_id: Column, checksum: Column, prompt: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", entity_id, checksum, prompt, model), 256)


def input_hash(mtime: Column, version: Column, language: Column) -> Column:
    return F.sha2(F.concat_ws("|", mtime.cast("string"), version.cast("string"), language), 256)


def priority(kind: Column, doc: Column, signature: Column, modifiers: Column) -> Column:
    """How much an entity wants an insight."""
    weight = F.lit(1)
    for value, names in TYPE_WEIGHTS.items():
        weight = F.when(kind.isin(*names), value).otherwise(weight)
    has = lambda word: F.coalesce(F.array_contains(modifiers, word), F.lit(False)).cast("int")
    undocumented = (F.coalesce(F.trim(doc), F.lit("")) == "").cast("int")
    return (weight + 80 * undocumented + F.least(F.lit(100), F.floor(F.coalesce(F.length(signature), F.lit(0)) / 5)) + 50 * has("public") + 40 * has("abstract")).cast("long")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up."""
    return F.floor((F.length(F.coalesce(text, F.lit(""))) + 3) / 4).cast("long")


def confidence(answer: Column) -> Column:
    """The first number under confidence or severityScore, in percent if above 1, within 0 and 1."""
    number = F.coalesce(*(F.when(F.get_json_object(answer, f"$.{k}").rlike(r"^-?[0-9.]+(?:[eE][-+]?[0-9]+)?$"), F.get_json_object(answer, f"$.{k}").try_cast("double")) for k in ("confidence", "severityScore")))
    share = F.when(number > 1, number / 100).otherwise(number)
    return F.when(share.isNull(), DEFAULT_CONFIDENCE).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))


def evidence(answer: Column, default: Column) -> Column:
    """All evidence that an answer names, each once, in order; the default if there is none."""
    read = F.from_json(answer, "evidence array<string>, upstream array<string>, downstream array<string>, issues array<struct<evidence:array<string>>>")
    none = F.array().cast("array<string>")
    lists = [F.coalesce(read[k], none) for k in ("evidence", "upstream", "downstream")]
    inner = F.flatten(F.transform(F.coalesce(read["issues"], F.array().cast("array<struct<evidence:array<string>>>")), lambda x: F.coalesce(x["evidence"], none)))
    found = F.array_distinct(F.array_compact(F.concat(*lists, inner)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(default))


def cleaned(answer: Column) -> Column:
    """An answer without the fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*", ""), r"\s*```$", "")


def first_text(values: Column, fallback: Column) -> Column:
    """The first non-blank value of a map of texts."""
    return F.coalesce(F.get(F.filter(F.map_values(values), lambda x: F.trim(x) != ""), F.lit(0)), fallback)


def structured(answer: Column, kind: Column, entity_id: Column, qualified_name: Column) -> Column:
    """map<string, string> of an answer with the fields that its kind asks for; texts that are no JSON keep 800 characters."""
    clean = cleaned(answer)
    read = F.from_json(clean, "map<string,string>")
    text = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))
    filled = read
    for name, fields in REQUIRED.items():
        extra = []
        for key, value in fields.items():
            default = F.concat(F.lit('["'), entity_id, F.lit('"]')) if value == "[id]" else first_text(read, qualified_name if value is None else F.lit("")) if key == "summary" else F.lit(value)
            extra += [F.lit(key), default]
        missing = F.map_filter(F.create_map(*extra), lambda k, v: ~F.coalesce(F.map_contains_key(read, k), F.lit(False)))
        filled = F.when(kind == name, F.map_concat(read, missing)).otherwise(filled)
    return (
        F.when(F.coalesce(F.trim(answer), F.lit("")) == "", text("summary", "[no answer]", "fallback", "true"))
        .when(read.isNull(), text("summary", "[not read]", "raw", F.substring(clean, 1, 800)))
        .when(F.size(read) == 0, text("summary", "[empty answer]", "raw", F.substring(clean, 1, 800)))
        .otherwise(filled)
    )
