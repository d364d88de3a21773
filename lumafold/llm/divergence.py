"""Quality rules by distribution divergence, in DataFrame functions only.

Each text gives two histograms: of character classes and of common words. Each is compared with the same
histogram of a language, gathered from all documents of that language, by the Jensen-Shannon distance (base
2, so from 0 to 1). A text takes the language that fits it best, whatever its label says. It is kept unless
it fails the base rules, or is long enough to judge and lies too far from every language.

The common words are learned: the ``top_words`` most frequent words with a letter of every language that the corpus
names, lower-cased, counted over all documents. The limit of the word distance is learned too, since a short text lies
farther from any reference than a long one: of the documents of a language with about as many words (the same power of
two), the median distance to their own language plus ``spread`` times what lies between the median and the lowest
twentieth (``min_spread`` at least). Both are taken from the lower half, which junk does not reach.

Guards: texts of fewer than ``min_words`` words have too little evidence for the word histogram, and of fewer
than ``min_chars`` characters for the classes; the guarded distance is not held against them. A language with
fewer than ``min_reference_words`` words in the corpus is no reference; a length of which it has fewer than
``min_documents`` documents takes the limit of the next shorter length, which is laxer (none, if there is no such); with no
reference at all nothing is rejected by distance.

Null texts count as empty: no words, so the base rule fails them. Repeated rows are judged each. An empty
table gives an empty result. Extra columns are ignored. A null language only keeps a text out of the
references. Quantiles are of distances in thousandths, so they need a count for each thousandth only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumafold.llm.common import drop_staged, stage, text_key

CLASSES = ("upper", "digit", "mark", "symbol", "space", "other")
SPLIT = r"[\x20\x09-\x0D]+"


def _lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPLIT), lambda w: w != "")


def vocabulary(docs: DataFrame, top_words: int = 50, min_reference_words: int = 1000) -> list[str]:
    """The common words of all languages, in order: at most ``top_words`` for each language that is a reference."""
    lang, text = F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    counts = docs.where("lang is not null").select(lang, F.explode(_words(F.lower(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    counts = stage(counts, "words-by-language")
    large = counts.groupBy("lang").agg(F.sum("n").alias("total")).where(F.col("total") >= min_reference_words).select("lang")
    lettered = counts.where(F.rlike("word", F.lit(r"\p{L}"))).join(F.broadcast(large), "lang")  # a row for each language
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = lettered.withColumn("place", place).where(F.col("place") <= top_words).select("word").distinct().collect()
    drop_staged(counts)
    return sorted(r["word"] for r in top)


def features(docs: DataFrame, common_words: list[str], with_keys: bool = False) -> DataFrame:
    """doc_id, lang, the base counts, the class histogram, and the common words in the text as (k, n): place among ``common_words``
    (the last place is that of all other words) and count; the text's key (__lf_key) if asked."""
    ids = ["doc_id", "__lf_key"] if with_keys else ["doc_id"]
    if with_keys:
        docs = docs.withColumn("__lf_key", text_key())
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.select(*ids, F.col("lang").cast("string").alias("lang"), text.alias("text")).select(
        "*", _words(F.col("text")).alias("words")
    )
    hashed = words.select(
        *ids, "lang", "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        _lines_with_words(F.col("text")).alias("lines"),
    )
    windows = hashed.withColumn(
        "w5", F.when(F.col("n_words") >= 5, F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    )
    repeated = windows.withColumn("pairs", F.when(F.size(F.array_distinct("w5")) < F.size("w5"), F.sort_array(F.transform("w5", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twice = F.filter(
        F.zip_with("pairs", F.slice("pairs", F.lit(2), F.size("pairs")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))), lambda x: x.isNotNull()
    )
    placed = repeated.withColumn("places", F.sort_array(F.array_distinct(F.flatten(twice))))
    # Windows of five words from ascending places cover min(5, distance to the place before) new words each.
    covered = F.aggregate("places", F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")), lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(5), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    def only(pattern: str) -> Column:
        return F.length(F.regexp_replace("text", f"[^{pattern}]+", "")).cast("long")

    counted = placed.select(
        *ids, "lang", "n_words",
        F.aggregate("words", F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
        only(r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.length("text").cast("long").alias("chars"),
        only(r"\p{Lu}").alias("upper"), only(r"\p{Nd}").alias("digit"), only(r".,;:!?'()\x22\x2D").alias("mark"),
        F.sort_array(_hits(F.col("words"), common_words)).alias("hits"),
    )
    space = F.col("chars") - F.col("word_chars")
    other = F.col("word_chars") - F.col("upper") - F.col("digit") - F.col("mark") - F.col("n_symbols")
    listed = F.lit(common_words) if common_words else F.array().cast("array<string>")
    # Equal hits stand together, so a word's count is the distance from its first place to the next word's.
    starts = F.filter(F.sequence(F.lit(0), F.size("hits") - 1), lambda i: (i == 0) | (F.get("hits", i) != F.get("hits", i - 1)))
    counted = counted.withColumn("starts", F.when(F.size("hits") > 0, starts).otherwise(F.array().cast("array<int>")))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("hits")))
    found = F.zip_with("starts", F.when(F.size("starts") > 0, ends).otherwise(F.array().cast("array<int>")), lambda a, b: F.struct((F.array_position(listed, F.get("hits", a)) - 1).cast("int").alias("k"), (b - a).cast("long").alias("n")))
    others = F.col("n_words") - F.size("hits")
    rest = F.when(others > 0, F.array(F.struct(F.lit(len(common_words)).alias("k"), others.cast("long").alias("n")))).otherwise(F.array().cast("array<struct<k:int,n:bigint>>"))
    return counted.select(
        *ids, "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars",
        F.array("upper", "digit", "mark", "n_symbols", space, other).alias("classes"),
        F.concat(found, rest).alias("common"),
    )


def _hits(words: Column, common_words: list[str]) -> Column:
    if not common_words:
        return F.array().cast("array<string>")
    return F.filter(F.transform(words, F.lower), lambda w: w.isin(common_words))


def _sums(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.col(name)[k]).cast("double") for k in range(size)])


def references(found: DataFrame, bins: int, min_reference_words: int = 1000) -> dict[str, tuple[list[float], list[float]]]:
    """The shares of classes and of common words (``bins`` of them) of each language with enough words, from all its documents."""
    mine = found.where("lang is not null")
    sums = mine.groupBy("lang").agg(F.sum("n_words").alias("total"), _sums("classes", len(CLASSES)).alias("classes")).where(F.col("total") >= min_reference_words).collect()  # a row for each language
    counts = {r["lang"]: [0.0] * bins for r in sums}
    for r in mine.select("lang", F.explode("common").alias("x")).groupBy("lang", "x.k").agg(F.sum("x.n").alias("n")).collect():  # a row for each language and common word
        if r["lang"] in counts:
            counts[r["lang"]][r["k"]] = float(r["n"])
    return {r["lang"]: tuple([x / sum(row) for x in row] for row in (r["classes"], counts[r["lang"]])) for r in sorted(sums, key=lambda r: r["lang"])}


def _term(a: Column, b: Column) -> Column:
    return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))


def js_distance(shares: str, ref: list[float]) -> Column:
    """Jensen-Shannon distance of a column of shares (null where there are none) from a reference."""
    terms = F.zip_with(shares, F.lit(ref), lambda a, b: _term(a, b) + _term(b, a))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x) / 2, F.lit(0.0)))


def sparse_distance(counts: str, total: str, ref: list[float]) -> Column:
    """The same from (k, n) counts: bins without a count add their reference share, so only the others are visited. Null for no counts."""
    shares = F.lit(ref)

    def add(acc: Column, x: Column) -> Column:
        p, q = x["n"] / F.col(total), F.get(shares, x["k"])
        return acc + _term(p, q) + _term(q, p) - q

    twice = F.aggregate(counts, F.lit(1.0), add)
    return F.when(F.col(total) > 0, F.sqrt(F.greatest(twice / 2, F.lit(0.0))))


def _shares(name: str) -> Column:
    total = F.aggregate(name, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(name, lambda x: F.try_divide(x, total))  # null where there is nothing to share


def _length_class(n_words: Column) -> Column:
    """Powers of two of the number of words (1 or more)."""
    return F.length(F.bin(n_words)).cast("int")


def word_limits(distances: DataFrame, spread: float, min_spread: float, min_documents: int) -> DataFrame:
    """language, length_class and limit: 63 rows for each language. ``distances``: lang, length_class, own."""
    thousandths = distances.where("own is not null").groupBy("lang", "length_class", F.floor(F.col("own") * 1000).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    group = Window.partitionBy("lang", "length_class")
    ranked = thousandths.select("lang", "length_class", "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("docs"))
    middle, low = (F.min(F.when(F.col("upto") * k >= F.col("docs"), F.col("bin"))) for k in (2, 20))
    found = ranked.where(F.col("docs") >= min_documents).groupBy("lang", "length_class").agg(middle.alias("middle"), low.alias("low"))
    limits = found.select(F.col("lang").alias("language"), "length_class", (F.col("middle") / 1000 + F.greatest(F.lit(spread) * (F.col("middle") - F.col("low")) / 1000, F.lit(min_spread))).alias("limit"))
    # A class with too few documents takes the limit of the next shorter one, which is laxer.
    every = limits.select("language").distinct().select("language", F.explode(F.sequence(F.lit(1), F.lit(63))).alias("length_class"))
    return every.join(limits, ["language", "length_class"], "left").withColumn("limit", F.last("limit", ignorenulls=True).over(Window.partitionBy("language").orderBy("length_class")))


def judge(
    docs: DataFrame, max_class_distance: float = 0.28, top_words: int = 50, spread: float = 2.5, min_spread: float = 0.05, min_words: int = 50,
    min_chars: int = 200, min_reference_words: int = 1000, min_documents: int = 30, with_keys: bool = False,
) -> DataFrame:
    """doc_id, the base counts, base_failed, language (best fit), class_distance, word_distance, word_limit, kept; the text's key (__lf_key) if asked."""
    ids = ["doc_id", "__lf_key"] if with_keys else ["doc_id"]
    common_words = vocabulary(docs, top_words, min_reference_words)
    found = stage(features(docs, common_words, with_keys), "divergence")
    refs = references(found, len(common_words) + 1, min_reference_words)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars"]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    shares = found.select(*ids, "lang", *counts, failed.alias("base_failed"), _shares("classes").alias("p_classes"), "common", _length_class(F.col("n_words")).alias("length_class"))
    none = F.array().cast("array<struct<sum:double,language:string,c:double,w:double>>")
    each = [(F.lit(lang).alias("language"), js_distance("p_classes", classes).alias("c"), sparse_distance("common", "n_words", words).alias("w")) for lang, (classes, words) in refs.items()]
    fits = F.transform(F.array(*[F.struct(*e) for e in each]), lambda x: F.struct((x["c"] + x["w"]).alias("sum"), x["language"].alias("language"), x["c"].alias("c"), x["w"].alias("w"))) if each else none
    measured = shares.select(*ids, "lang", *counts, "base_failed", "length_class", fits.alias("fits"))
    best = F.array_min(F.filter("fits", lambda x: x["sum"].isNotNull()))
    own = F.get(F.filter("fits", lambda x: x["language"] == F.col("lang")), F.lit(0))
    placed = measured.select(*ids, "lang", *counts, "base_failed", "length_class", best.alias("best"), own.alias("own"))
    placed = stage(placed.select(*ids, "lang", *counts, "base_failed", "length_class", F.col("best.language").alias("language"), F.col("best.c").alias("class_distance"), F.col("best.w").alias("word_distance"), F.col("own.w").alias("own")), "distances")
    limits = stage(word_limits(placed.where("not base_failed"), spread, min_spread, min_documents), "limits")  # 63 rows a language
    met = placed.join(F.broadcast(limits.withColumnRenamed("limit", "word_limit")), ["language", "length_class"], "left")
    far = (F.col("chars") >= min_chars) & F.coalesce(F.col("class_distance") > max_class_distance, F.lit(False))
    strange = (F.col("n_words") >= min_words) & F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    drop_staged(found)
    return met.select(*ids, *counts[:-1], "base_failed", "language", "class_distance", "word_distance", "word_limit", (~F.col("base_failed") & ~far & ~strange).alias("kept"))


def sql(
    max_class_distance: float = 0.28, top_words: int = 50, spread: float = 2.5, min_spread: float = 0.05, min_words: int = 50,
    min_chars: int = 200, min_reference_words: int = 1000, min_documents: int = 30,
) -> str:
    """The same verdict in SQL, for checking: dense histograms, and limits by the same rule."""

    def only(pattern: str) -> str:
        return f"length(regexp_replace(text, '[^{pattern}]+', '', 'g'))"

    def sums(name: str, size: int) -> str:
        return "[" + ", ".join(f"sum({name}[{k + 1}])::DOUBLE" for k in range(size)) + "]"

    def distance(p: str, q: str) -> str:
        def term(a: str, b: str) -> str:
            return f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"

        x, y = "z[1] / (list_sum(%s) + 0.0)" % p, "z[2] / (list_sum(%s) + 0.0)" % q
        body = f"list_transform(list_zip({p}, {q}), lambda z: [{x}, {y}])"
        return f"sqrt(greatest(list_sum(list_transform({body}, lambda t: {term('t[1]', 't[2]')} + {term('t[2]', 't[1]')})) / 2, 0))"

    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), windows AS (
  SELECT r, k, count(*) OVER (PARTITION BY r, array_to_string(w[k + 1 : k + 5], ' ')) AS times
  FROM (SELECT r, w, unnest(range(len(w) - 4)) AS k FROM cut WHERE len(w) >= 5)
), repeated AS (
  SELECT r, count(DISTINCT k + s) AS n FROM windows, range(5) AS t(s) WHERE times > 1 GROUP BY r
), counted AS (
  SELECT cut.r, doc_id, lang, text, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, {only("#*$%&|<>")} AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
         - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
         coalesce(repeated.n, 0) AS n_repeat_words, length(text) AS chars,
         {only("\\p{Lu}")} AS up, {only("\\p{Nd}")} AS dig, {only(".,;:!?''()\\x22\\x2D")} AS mark
  FROM cut LEFT JOIN repeated ON repeated.r = cut.r
), spoken AS (
  SELECT lang, lower(x) AS word, count(*) AS n FROM (SELECT lang, unnest(w) AS x FROM cut WHERE lang IS NOT NULL) GROUP BY 1, 2
), tops AS (
  SELECT word FROM spoken WHERE regexp_matches(word, '\\p{{L}}') AND lang IN (SELECT lang FROM spoken GROUP BY lang HAVING sum(n) >= {min_reference_words})
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {top_words}
), bins AS (
  SELECT coalesce(list(DISTINCT word), []) AS words FROM tops
), hist AS (
  SELECT counted2.*, [up, dig, mark, n_symbols, chars - word_chars, word_chars - up - dig - mark - n_symbols] AS classes,
         list_transform(list_transform(bins.words, lambda b: [b]), lambda b: len(list_filter(lw, lambda x: x = b[1]))) AS hits
  FROM (SELECT *, list_transform(w, lambda x: lower(x)) AS lw FROM counted) AS counted2, bins
), found AS (
  SELECT * EXCLUDE (hits, lw), list_append(hits, n_words - coalesce(list_sum(hits), 0)::BIGINT) AS common FROM hist
), refs AS (
  SELECT lang AS language, {sums("classes", len(CLASSES))} AS ref_classes, ref_common FROM found JOIN (
    SELECT lang, list(n ORDER BY k) AS ref_common FROM (SELECT lang, k, sum(c)::DOUBLE AS n FROM (SELECT lang, unnest(common) AS c, unnest(range(len(common))) AS k FROM found) GROUP BY ALL) GROUP BY lang
  ) USING (lang) GROUP BY ALL HAVING sum(n_words) >= {min_reference_words}
), fits AS (
  SELECT r, lang, {distance("classes", "ref_classes")} AS c, {distance("common", "ref_common")} AS d, language FROM found, refs
), best AS (
  SELECT r, c, d, language FROM fits WHERE NOT isnan(c + d) AND c + d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r ORDER BY c + d, language) = 1
), based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, length(bin(n_words)) AS length_class FROM found
), binned AS (
  SELECT based.lang, length_class, floor(d * 1000)::BIGINT AS b, count(*) AS n FROM based JOIN fits ON fits.r = based.r AND fits.language = based.lang
  WHERE NOT base_failed AND d IS NOT NULL AND NOT isnan(d) GROUP BY ALL
), ranked AS (
  SELECT lang, length_class, b, sum(n) OVER (PARTITION BY lang, length_class ORDER BY b) AS upto, sum(n) OVER (PARTITION BY lang, length_class) AS docs FROM binned
), few AS (
  SELECT lang AS language, length_class, middle / 1000 + greatest({spread}::DOUBLE * (middle - low) / 1000, {min_spread}::DOUBLE) AS word_limit FROM (
    SELECT lang, length_class, min(b) FILTER (WHERE upto * 2 >= docs) AS middle, min(b) FILTER (WHERE upto * 20 >= docs) AS low FROM ranked WHERE docs >= {min_documents} GROUP BY ALL)
), limits AS (
  SELECT language, length_class, last_value(word_limit IGNORE NULLS) OVER (PARTITION BY language ORDER BY length_class) AS word_limit
  FROM (SELECT DISTINCT language FROM few) JOIN range(1, 64) AS t(length_class) ON true LEFT JOIN few USING (language, length_class)
), judged AS (
  SELECT based.*, chars >= {min_chars} AND coalesce(c > {max_class_distance}, false) OR n_words >= {min_words} AND coalesce(d > word_limit, false) AS far
  FROM based LEFT JOIN best ON best.r = based.r LEFT JOIN limits ON limits.language = best.language AND limits.length_class = based.length_class
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept
FROM judged
"""
