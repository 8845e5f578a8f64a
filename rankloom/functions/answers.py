"""Reading judges' answers: the JSON object in a text that may hold more, and may be slightly broken."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
_KEY = re.compile(r"^(?:doc(?:ument)?[\s_-]*)?0*([1-9][0-9]*)$", re.I)
_ESCAPE = re.compile(r'\\(?!["\\/bfnrtu])')


def _unique(pairs):
    keys = [k for k, _ in pairs]
    if len(set(keys)) < len(keys):
        raise KeyError("a key occurs twice")
    return dict(pairs)


def decode(text: str | None) -> tuple[str, dict | None]:
    """(category, object): ``ok``, or why there is none: ``empty``, ``duplicate``, ``json``.

    Reads what follows the last end of thinking, inside a fence if there is one, from the first brace on; a stray escape
    is repaired once.
    """
    body = (text or "").rpartition("</think>")[2]
    fenced = _FENCE.search(body)
    body = fenced[1] if fenced else body
    at = body.find("{")
    if at < 0:
        return "empty", None
    for candidate in (body[at:], _ESCAPE.sub(r"\\\\", body[at:])):
        try:
            return "ok", json.JSONDecoder(object_pairs_hook=_unique).raw_decode(candidate)[0]
        except KeyError:
            return "duplicate", None
        except ValueError:
            continue
    return "json", None


def listwise(text: str | None, slots: int) -> dict:
    """{category, scores}: finite scores of the documents 1 to ``slots``, or ``schema`` / ``incomplete``."""
    category, found = decode(text)
    scores: dict[int, float] = {}
    for k, v in (found or {}).items():
        m = _KEY.match(str(k).strip())
        if not m or isinstance(v, bool) or not isinstance(v, (int, float)) or v - v != 0:
            return {"category": "schema", "scores": None}
        scores[int(m[1])] = float(v)
    if category == "ok" and set(scores) != set(range(1, slots + 1)):
        category = "incomplete" if set(scores) < set(range(1, slots + 1)) else "schema"
    return {"category": category, "scores": scores if category == "ok" else None}


def listwise_scores(text: Column, slots: Column) -> Column:
    """Column form of ``listwise``."""

    @F.pandas_udf("category string, scores map<int, double>")
    def read(text: pd.Series, slots: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([listwise(t, int(n)) for t, n in zip(text, slots)], columns=["category", "scores"])

    return read(text, slots)


def rubric(text: str | None, slots: int, criteria: int) -> dict:
    """{category, verdicts}: for documents 1 to ``slots`` their 0 or 1 on C1 to C``criteria``, in that order.

    ``schema``: a key that names no document of the window or one twice, an entry without criteria, other criteria than
    those asked (more or fewer), a verdict that is neither 0 nor 1 nor such a string. ``incomplete``: all right, but a
    document is left out. Else as ``decode`` says. Nothing is kept of an answer that is not ``ok``.
    """
    if slots < 1 or criteria < 1:
        raise ValueError("a window shows a document at least, and asks a criterion at least")
    category, found = decode(text)
    labels = [f"C{k}" for k in range(1, criteria + 1)]
    verdicts: dict[int, list[int]] = {}
    for key, value in (found or {}).items():
        m = _KEY.match(str(key).strip())
        place = int(m[1]) if m else 0
        answered = value.get("criteria") if isinstance(value, dict) else None
        if not 1 <= place <= slots or place in verdicts or not isinstance(answered, dict) or set(answered) != set(labels):
            return {"category": "schema", "verdicts": None}
        row = [answered[c] for c in labels]
        if not all(type(v) is int and v in (0, 1) or isinstance(v, str) and v in ("0", "1") for v in row):
            return {"category": "schema", "verdicts": None}
        verdicts[place] = [int(v) for v in row]
    if category == "ok" and len(verdicts) < slots:
        category = "incomplete"
    return {"category": category, "verdicts": verdicts if category == "ok" else None}


def rubric_verdicts(text: Column, slots: Column, criteria: int) -> Column:
    """Column form of ``rubric``: a struct of category and a map from a document's number to its verdict vector."""

    @F.pandas_udf("category string, verdicts map<int, array<int>>")
    def read(text: pd.Series, slots: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([rubric(t, int(n), criteria) for t, n in zip(text, slots)], columns=["category", "verdicts"])

    return read(text, slots)


def verdict_vector(criteria: Column, labels: list[str]) -> Column:
    """The 0 or 1 of each label, in order, out of a map by label; a label missing, unknown or neither 0 nor 1 is an error."""
    odd = (F.size(criteria) != len(labels)) | F.exists(F.array(*[F.lit(x) for x in labels]), lambda x: ~F.coalesce(F.element_at(criteria, x).isin(0, 1), F.lit(False)))
    vector = F.array(*[F.element_at(criteria, F.lit(x)).cast("int") for x in labels])
    return F.when(odd, F.raise_error(F.concat(F.lit("verdicts do not cover the criteria: "), F.to_json(criteria)))).otherwise(vector)
