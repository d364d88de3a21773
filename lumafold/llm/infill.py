"""Fill-in-the-middle rearrangement of texts.

A text is cut into units (a word with the white space before it, or white space at its end). Two numbers derived from the
row's id choose where the middle starts and ends, two more choose the form: plain, psm (prefix, suffix, middle) or
spm (suffix, prefix, middle). Everything depends on the row's id and text only, so a lost task repeats it equally.

Units aren't kept: their end offsets go into one compact array, and two lookups in it slice the text.

Null texts are empty, and empty texts plain. A text that holds one of the marks is plain, so that the form can be undone. A row
without an id takes the empty text for its id's digits. Equal rows give equal results. Other columns stay or are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = ("<P>", "<S>", "<M>")
SEED = 42
#: Shares of a hundred: texts that are rearranged, and spm among these.
JOINED_BELOW, SPM_BELOW = 50, 80

_UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")


def unit_ends(text: str) -> array:
    """The offset at which each unit ends."""
    return array("q", [m.end() for m in _UNIT.finditer(text)])


def draws(doc_id: str | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that belong to an id."""
    found = hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()
    return tuple(int(found[k : k + 8], 16) for k in (0, 8, 16, 24))


def cut(text: str, doc_id: str | None, seed: int = SEED, joined_below: int = JOINED_BELOW, spm_below: int = SPM_BELOW) -> tuple[int, str, int, int]:
    """The number of units, the form, and the offsets where the prefix and the middle end.

    Texts stay plain where the third draw leaves ``joined_below`` or more of a hundred.
    """
    ends = unit_ends(text)
    one, two, three, four = draws(doc_id, seed)
    low, high = sorted((one % (len(ends) + 1), two % (len(ends) + 1)))
    if not text or three % 100 >= joined_below or any(m in text for m in MARKS):
        return len(ends), "plain", 0, 0
    return len(ends), "spm" if four % 100 < spm_below else "psm", ends[low - 1] if low else 0, ends[high - 1] if high else 0


def joined(text: str, form: str, start: int, end: int) -> str:
    """The text in its form."""
    if form == "plain":
        return text
    p, s, m = MARKS
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    return f"{p}{prefix}{s}{suffix}{m}{middle}" if form == "psm" else f"{s}{suffix}{p}{prefix}{m}{middle}"


def restored(output: str, form: str) -> str:
    """The text that ``joined`` was given."""
    if form == "plain":
        return output
    p, s, m = MARKS
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output.removeprefix(first).partition(second)
    other, _, middle = rest.partition(m)
    return one + middle + other if form == "psm" else other + middle + one


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _results(doc_id: pd.Series, text: pd.Series, digests: bool) -> pd.DataFrame:
    rows = []
    for i, t in zip(doc_id.tolist(), text.tolist(), strict=True):
        n, form, start, end = cut(t, i)
        output = joined(t, form, start, end)
        sizes = (None, None) if form == "plain" else (start, end - start)
        rows.append((n, form, *sizes, *((_sha(output), _sha(restored(output, form))) if digests else (output,))))
    last = ["output_sha256", "restored_sha256"] if digests else ["output"]
    out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", *last])
    return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})


def _rearranged(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
    return _results(doc_id, text, False)


def _digested(doc_id: pd.Series, text: pd.Series) -> pd.DataFrame:
    return _results(doc_id, text, True)


def _called(made: Callable[[pd.Series, pd.Series], pd.DataFrame], last: str) -> Column:
    udf = F.pandas_udf(made, f"n long, form string, prefix_chars long, middle_chars long, {last}")
    return udf(F.col("doc_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def fill_in_middle(docs: DataFrame, column: str = "__lf_fim") -> DataFrame:
    """``docs`` with its text in its form; adds ``form``. Other columns stay, but for one named form."""
    names = [c for c in docs.columns if c != "form"]
    made = docs.withColumn(column, _called(_rearranged, "output string"))
    return made.select(*(F.col(column)["output"].alias("text") if c == "text" else F.col(f"`{c}`") for c in names), F.col(column)["form"].alias("form"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256: a row for each row."""
    return docs.select("doc_id", _called(_digested, "output_sha256 string, restored_sha256 string").alias("x")).select("doc_id", "x.*")


SQL = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w, sha256('42:' || doc_id) AS s FROM documents
), drawn AS (
  SELECT doc_id, t, w, len(w) AS n, ('0x' || s[1:8])::BIGINT % (len(w) + 1) AS a, ('0x' || s[9:16])::BIGINT % (len(w) + 1) AS b,
         ('0x' || s[17:24])::BIGINT % 100 AS c, ('0x' || s[25:32])::BIGINT % 100 AS d
  FROM units
), sliced AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain' WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(w[1 : least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1 : greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1 :], '') AS x
  FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM sliced
"""
