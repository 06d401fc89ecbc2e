"""JSON of mixed types as VARIANT: values keep their kinds, and nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CASES = "array<struct<stdin: string, expected_stdout: string>>"


def canonical(text: Column) -> Column:
    """Compact JSON with sorted keys; null for what is not JSON. Numbers are written by value, so 1.50 and 1.5 are alike, and 1.0 and 1."""
    return F.to_json(F.try_parse_json(text))


def canonical_sha256(text: Column) -> Column:
    """sha256 of the canonical form: texts of one JSON value have one digest, whatever their key order and white space."""
    return F.sha2(canonical(text), 256)


def kind(value: Column) -> Column:
    """string, number, boolean, array, object or null of a variant."""
    of = F.schema_of_variant(value)
    return F.when(value.isNull() | (of == "VOID"), "null").when(of == "STRING", "string").when(of == "BOOLEAN", "boolean").when(of.startswith("ARRAY"), "array").when(of.startswith("OBJECT"), "object").otherwise("number")


def _fail(why: str, as_type: str) -> Column:
    return F.raise_error(F.lit(why)).cast(as_type)


def _text(value: Column) -> Column:
    """A string, or a list of strings as lines; anything else raises."""
    lines = F.schema_of_variant(value).isin("ARRAY<STRING>", "ARRAY<VOID>")
    joined = F.array_join(F.try_variant_get(value, "$", "array<string>"), "\n")
    return F.when(kind(value) == "string", F.variant_get(value, "$", "string")).when(lines, joined).otherwise(_fail("standard-input cases are texts or lists of lines", "string"))


def _arguments(value: Column) -> Column:
    return F.when(kind(value) == "array", F.to_json(value)).otherwise(_fail("call-based inputs are lists of arguments", "string"))


def test_cases(raw: Column) -> Column:
    """struct(fn_name, cases) of a JSON object with lists ``inputs`` and ``outputs`` of one length, and ``fn_name`` for cases that call a function.

    A case that calls has its arguments and its result as JSON; another has
    texts, where a list of strings is one text of lines. Whatever is of another
    form raises; a null gives a null.
    """
    value = F.parse_json(raw)
    name = F.nullif(F.try_variant_get(value, "$.fn_name", "string"), F.lit(""))
    inputs, outputs = (F.try_variant_get(value, f"$.{k}", "array<variant>") for k in ("inputs", "outputs"))
    calls = F.transform(F.arrays_zip(inputs.alias("i"), outputs.alias("o")), lambda x: F.struct(_arguments(x["i"]).alias("stdin"), F.to_json(x["o"]).alias("expected_stdout")))
    texts = F.transform(F.arrays_zip(inputs.alias("i"), outputs.alias("o")), lambda x: F.struct(_text(x["i"]).alias("stdin"), _text(x["o"]).alias("expected_stdout")))
    made = F.struct(name.alias("fn_name"), F.when(name.isNull(), texts).otherwise(calls).alias("cases"))
    kinds = f"struct<fn_name: string, cases: {CASES}>"
    return (
        F.when(raw.isNull(), F.lit(None).cast(kinds))
        .when(kind(value) != "object", _fail("test cases are a JSON object", kinds))
        .when(inputs.isNull() | outputs.isNull() | (F.size(inputs) != F.size(outputs)), _fail("inputs and outputs are lists of one length", kinds))
        .when(name.isNotNull() & ~name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$"), _fail("fn_name names a function", kinds))
        .otherwise(made)
    )
