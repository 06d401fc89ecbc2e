"""Certificates that go with actions, checked against declared fields; malformed ones are mended where they can be."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

Check = Callable[[object], bool]


def _said(x: object, most: int = 1 << 30) -> bool:
    return isinstance(x, str) and bool(x.strip()) and len(x) <= most


def _names(x: object, start: str, most: int = 1 << 30, distinct: bool = False) -> bool:
    return isinstance(x, list) and 0 < len(x) <= most and all(isinstance(i, str) and i.startswith(start) for i in x) and (not distinct or len(set(x)) == len(x))


_REF = re.compile(r"[A-Za-z][A-Za-z0-9_:-]{0,63}")
# Operations of a reasoning step, and the field of each one's output.
OUTPUT_FIELDS = {
    "select_exact_span": "text",
    "extract_bridge_entity": "bridge_entity",
    "extract_answer_candidate": "answer_candidate",
    "normalize_answer": "normalized_answer",
    "compare_equal": "equal",
}

#: Fields of each kind of certificate, the check of each and the error it gives.
KINDS: dict[str, dict[str, tuple[Check, str]]] = {
    "submission": {
        "final_code_artifact_id": (lambda x: isinstance(x, str) and x.startswith("code:"), "final_code_artifact_id_invalid"),
        "final_code_sha256": (lambda x: isinstance(x, str) and len(x) == 64, "final_code_sha256_invalid"),
        "evidence_run_ids": (lambda x: _names(x, "run:"), "evidence_run_ids_invalid"),
        "claim": (_said, "claim_invalid"),
    },
    "visual": {
        "schema_version": (lambda x: isinstance(x, str) and bool(x), "schema_version_invalid"),
        "evidence_artifact_ids": (lambda x: _names(x, "image:crop:", 2, True), "evidence_artifact_ids_invalid"),
        "claim": (lambda x: _said(x, 500), "claim_invalid"),
    },
    "reason_step": {
        "ref": (lambda x: isinstance(x, str) and bool(_REF.fullmatch(x)), "ref_invalid"),
        "op": (lambda x: isinstance(x, str) and x in OUTPUT_FIELDS, "op_invalid"),
        "premises": (lambda x: isinstance(x, list) and len(x) <= 8 and all(isinstance(p, dict) and set(p) == {"artifact_id", "span"} and _said(p["artifact_id"]) and _said(p["span"]) for p in x), "premises_invalid"),
        "inputs": (lambda x: isinstance(x, list) and len(x) <= 8 and all(isinstance(i, str) and _REF.fullmatch(i) for i in x) and len(set(x)) == len(x), "inputs_invalid"),
        "output": (lambda x: isinstance(x, dict), "output_not_object"),
    },
    "search": {"source_id": (_said, "source_id_invalid"), "support_span": (_said, "support_span_invalid"), "target": (_said, "target_invalid")},
    "finish": {"source_id": (_said, "source_id_invalid"), "support_span": (_said, "support_span_invalid"), "answer_span": (_said, "answer_span_invalid")},
}
#: Kinds whose text may be mended, with the fields that it cannot do without.
MENDED = {"search": ("source_id", "support_span"), "finish": ("source_id", "support_span")}


def _mended(text: str, fields: list[str]) -> dict[str, str]:
    """Fields found in broken JSON: ``"name": "value"``, a bare value, a comma for a colon, or a brace after the name."""
    out = {}
    for k, name in enumerate(fields):
        others = "|".join(map(re.escape, fields[k + 1 :])) or r"\Z\B"
        tries = (rf'"{name}"\s*[:,]\s*"([^"]*)"', rf'"{name}"\s*:\s*([^\s",}}]+)', rf'"?{name}"?\}}\s*(.*?)\s*(?="?(?:{others})\b|\Z)')
        found = next((m[1].strip() for t in tries if (m := re.search(t, text, re.DOTALL)) and m[1].strip()), None)
        if found:
            out[name] = found.rstrip('"},').strip() if found != found.rstrip('"},') else found
    return out


def certificate(value: object, kind: str) -> tuple[dict | None, list[str]]:
    """(fields, errors) of a certificate given as a mapping or as text; None if it cannot be used."""
    spec = KINDS[kind]
    errors: list[str] = []
    mended = False
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            if kind not in MENDED or not value.strip():
                return None, ["certificate_not_object"]
            value, mended = _mended(value, list(spec)), True
            if any(f not in value for f in MENDED[kind]):
                return None, ["certificate_not_object"]
    if not isinstance(value, dict):
        return None, ["certificate_not_object"]
    if (set(spec) - set(value)) if mended else set(value) != set(spec):
        errors.append("certificate_fields_invalid")
        if kind not in MENDED and kind != "reason_step":
            return None, errors
    errors += [error for name, (ok, error) in spec.items() if not ok(value.get(name))]
    if mended:
        errors.append("certificate_repaired")
    core = MENDED.get(kind)
    usable = all(spec[f][0](value.get(f)) for f in core) if core else not errors
    tidy = {k: " ".join(x.split()) if core and isinstance(x := value.get(k), str) else value.get(k) for k in spec}
    return (tidy if usable else None), errors


def certificate_column(kind: str):
    """A column function from a certificate's text to struct(usable, fields as JSON, errors)."""

    @F.pandas_udf(T.StructType([T.StructField("usable", T.BooleanType()), T.StructField("fields", T.StringType()), T.StructField("errors", T.ArrayType(T.StringType()))]))
    def read(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            fields, errors = certificate(t, kind)
            rows.append((fields is not None, json.dumps(fields, ensure_ascii=False, sort_keys=True) if fields is not None else None, errors))
        return pd.DataFrame(rows, columns=["usable", "fields", "errors"])

    return read
