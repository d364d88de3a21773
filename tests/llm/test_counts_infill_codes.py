"""Token counts, fill-in-middle and vector codes against brute force."""

import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from lumafold.llm import codebooks, infill, piece_counts
from lumafold.session import table

MODEL = public_tokenizers.path("piece_bpe_32k.model")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


# op11 --------------------------------------------------------------------------------------------------------------------


def wild_texts(rng, n):
    letters = "ab e\n\t\r ▁.,'é日本語ß\U0001f600\x00​　<s>/unk0x1A"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    return out + ["a" * 5000, "日本" * 300, " " * 77, "\n" * 40, " a" * 2000, "x" * 70 + " y", "<s>a</s>", "<0x0A>", "tail   "]


def test_pretokens_count_as_the_library_does(rng, library):
    model = piece_counts.PieceModel(MODEL)
    for text in wild_texts(rng, 400):
        words = model.pretokens(text)
        assert "".join(words) == " " + text.replace("▁", " ")
        assert sum(model.pieces(words)) == len(library.encode(text)), text


@pytest.mark.parametrize("head", [0, 20, piece_counts.HEAD])
def test_token_counts_equal_the_library(spark, make, odd, rng, library, head):
    rows = odd + [(100 + k, t) for k, t in enumerate(wild_texts(rng, 60))] + [(7, "same words here")] * 3
    got = piece_counts.token_counts(make(rows), MODEL, limit=40, head=head).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 40) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_token_counts_of_whole_table(spark, sf, library):
    got = {r["doc_id"]: r["n_tokens"] for r in piece_counts.token_counts(table(spark, sf, "documents"), MODEL, head=500).collect()}
    assert got == {r["doc_id"]: len(library.encode(r["text"] or "")) for r in table(spark, sf, "documents").collect()}


def test_token_counts_of_nothing_and_of_a_very_long_text(spark, make, library):
    assert piece_counts.token_counts(make([(1, "a")]).limit(0), MODEL).count() == 0
    long = "\n".join(f"word{k % 977} and more {k}" for k in range(60_000))
    row = piece_counts.token_counts(make([(1, long), (2, None)]), MODEL, head=100).orderBy("doc_id").first()
    assert row["n_tokens"] == len(library.encode(long)) and row["over_limit"]


# op12 --------------------------------------------------------------------------------------------------------------------


def brute_infill(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    form = "spm" if h4 % 100 < 80 else "psm"
    return doc_id, len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_infill_equals_brute_force(spark, make, odd, rng):
    rows = odd + [(k, "".join(rng.choice("ab \n\t日é\U0001f600　") for _ in range(rng.randrange(80)))) for k in range(10, 300)]
    rows += [(400 + k, f"has a {m} mark") for k, m in enumerate(["<P>", "<S>", "<M>"] * 4)] + [((1 << 62) + 1, "large id"), ((1 << 62) + 3, "large id")]
    rows += [(9, "tie tie"), (9, "tie tie"), (500, "long  word \n" * 200_000)]
    want = [brute_infill(*r) for r in rows]
    made = infill.digests(make(rows)).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted(map(str, map(tuple, made))) == sorted(str((*w[:5], sha(w[5]), sha(t))) for w, (_, t) in zip(want, rows, strict=True))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    docs = make(rows).withColumnRenamed("late", "form")
    out = infill.fill_in_middle(docs)
    assert out.columns == docs.drop("form").columns + ["form"]
    assert sorted(map(str, ((r["doc_id"], r["form"], r["text"]) for r in out.collect()))) == sorted(str((w[0], w[2], w[5])) for w in want)
    assert infill.digests(make(rows).limit(0)).count() == 0


@pytest.mark.parametrize("form", ["plain", "psm", "spm"])
def test_infill_is_undone(rng, form):
    for _ in range(200):
        text = "".join(rng.choice("ab <P\n日") for _ in range(rng.randrange(30))).replace("<P>", "")
        a, b = sorted((rng.randrange(len(text) + 1), rng.randrange(len(text) + 1)))
        assert infill.restored(infill.joined(text, form, a, b), form) == text


# op13 --------------------------------------------------------------------------------------------------------------------


def brute_codes(rows, rounds=6, entries=16, parts=8):
    kept = [(i, [int(np.floor(4096 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in kept]
    width = min(set(lengths), key=lambda n: (-lengths.count(n), n))
    kept = [r for r in kept if len(r[1]) == width]
    step = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, np.array(r[1], "<i4").tobytes()))[:entries]
    books = [[v[p * step : (p + 1) * step] for _, v, _ in first] for p in range(parts)]
    near = lambda book, x: min((sum((a - b) ** 2 for a, b in zip(e, x, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine = [v[p * step : (p + 1) * step] for _, v, _ in kept]
            to = [near(books[p], x)[1] for x in mine]
            books[p] = [[sum(c) // len(c) for c in zip(*[x for x, t in zip(mine, to, strict=True) if t == k], strict=True)] if k in to else e for k, e in enumerate(books[p])]
    out, sums = [], {}
    for i, v, lab in kept:
        found = [near(books[p], v[p * step : (p + 1) * step]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    text = ",".join(str(c) for book in books for e in book for c in e)
    return [(i, code, err, sums[lab], hashlib.sha256(text.encode()).hexdigest()) for i, code, err, lab in out]


def test_kd_tree_equals_scan_with_ties(rng):
    for _ in range(60):
        entries = np.array([[rng.randrange(-3, 4) for _ in range(3)] for _ in range(rng.randrange(1, 40))], np.int64)
        points = np.array([[rng.randrange(-5, 6) for _ in range(3)] for _ in range(200)], np.int64)
        index, best = codebooks.KdTree(entries).nearest(points)
        d = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (index == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


def vectors_of(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", *(f"'x' AS {c}" for c in ("id", "v", "code", "error", "part", "entry", "label_error")))


def test_codes_equal_brute_force(spark, rng):
    rows = [(k, [rng.choice([-1.5, -0.25, 0.0, 0.3, 1.0]) for _ in range(16)], rng.choice([None, 1, 2])) for k in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.0] * 15, 1), (202, [float("nan")] + [0.0] * 15, 2), (203, [float("inf")] * 16, 2), (204, [0.5] * 8, 1), (205, [], 1)]
    rows += [rows[3]] * 40 + [(3, rows[5][1], 2), (None, rows[7][1], None)]
    got = codebooks.code_table(vectors_of(spark, rows)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_codes(rows)))


def test_few_or_no_vectors(spark):
    rows = [(k, [float(k)] * 8, None) for k in range(3)]
    assert sorted(map(str, map(tuple, codebooks.code_table(vectors_of(spark, rows)).collect()))) == sorted(map(str, brute_codes(rows)))
    assert codebooks.code_table(vectors_of(spark, rows).limit(0)).count() == 0
    assert codebooks.code_table(vectors_of(spark, [(1, None, 1)])).count() == 0


def test_components_beyond_reach_are_an_error(spark):
    with pytest.raises(Exception, match="components must stay below"):
        codebooks.code_table(vectors_of(spark, [(1, [1e30] * 8, 1)])).count()
