"""Spelling variants: words one edit apart, met in bands of a letter-parity bitmask.

A word's mask has a bit for every letter: whether the letter occurs an odd number of times. One edit flips at most two bits,
so of three bands of the mask one stays as it was. Words join where a band and the shorter length are equal and, since an
edit changes only one half of a word, where one half is equal too; the band alone would meet a hundred times as many pairs.
Pairs with more than two flipped bits fall, the rest is verified by edit distance. All of it is DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lensfold.llm.common import discard, save

LETTERS = r"[A-Za-zÀ-ÿ]+"
BANDS, BITS = 3, 60


def lower_ascii(word: Column) -> Column:
    """``word`` with A-Z lower-cased and all else as it is."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def vocabulary(docs: DataFrame, drop_each: int = 97, min_length: int = 5, min_count: int = 3) -> DataFrame:
    """``word, n`` for the words of ``docs(doc_id, text)`` with at least ``min_length`` letters and ``min_count`` occurrences.

    Of every ``drop_each``-th (document, run of letters) by crc32 one letter is deleted. Null texts have no runs, a null
    doc_id is empty text. Counts are added up in each task first, so no word is hot.
    """
    run = F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = runs.select(F.when(h % drop_each == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def with_masks(words: DataFrame) -> DataFrame:
    """``words(word, n)`` with ``m0, m1, m2``: the bands of each word's parity mask, 60 bits each.

    Letters are dealt to the bands in the order of how many words have them, there and back, so that all bands tell words
    apart about equally well. That order is all that reaches the driver, for the first 180 letters; others share bits by
    their code points, which flips two bits at most as well.
    """
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''").groupBy("letter").count()
    alphabet = "".join(r["letter"] for r in letters.orderBy(F.desc("count"), "letter").limit(BANDS * BITS).collect())

    def rank(letter: Column) -> Column:
        place = F.instr(F.lit(alphabet), letter)
        return F.when(place > 0, place - 1).otherwise(F.ascii(letter) % (BANDS * BITS))

    ranks = words.withColumn("ranks", F.transform(F.filter(F.split("word", ""), lambda c: c != ""), rank))

    def mask(b: int) -> Column:
        turns = [k for k in range(2 * BANDS) if min(k, 2 * BANDS - 1 - k) == b]
        flip = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(r / BANDS).cast("int"))
        return F.aggregate("ranks", F.lit(0).cast("long"), lambda m, r: F.when((r % (2 * BANDS)).isin(turns), m.bitwiseXOR(flip(r))).otherwise(m))

    return ranks.select(*words.columns, *(mask(b).alias(f"m{b}") for b in range(BANDS)))


def _filed(masks: DataFrame, longer: bool) -> DataFrame:
    """``masks`` once for each band and half, with a key of band, half, shorter length and the half's text."""
    short = F.char_length("word") - int(longer)
    first = F.floor(short / 2).cast("int")
    halves = F.substring("word", F.lit(1), first), F.substring("word", F.char_length("word") - (short - first) + 1, short - first)
    places = []
    for b in range(BANDS):
        for h, text in enumerate(halves):
            key = F.xxhash64(F.lit(b * 2 + h), F.col(f"m{b}"), short, text)
            places.append(F.struct(F.lit(b).cast("byte").alias("band"), F.lit(h).cast("byte").alias("half"), key.alias("key")))
    return masks.withColumn("longer", F.lit(longer)).withColumn("k", F.explode(F.array(*places))).select("k.*", "longer", *masks.columns)


def near_words(words: DataFrame) -> DataFrame:
    """``a, b, a_n, b_n``: each pair of ``words(word, n)`` that one inserted, deleted or replaced code point makes equal, once.

    Words join as the shorter or equal one of a pair with those of their own length and of one more. A pair that agrees in
    several bands and halves is taken in the first. ``words`` must be distinct, without nulls.
    """
    masks = save(with_masks(words))
    equal = _filed(masks, longer=False)
    a, b = equal.alias("a"), equal.unionByName(_filed(masks, longer=True)).alias("b")
    same = [F.col(f"a.m{k}") == F.col(f"b.m{k}") for k in range(BANDS)]
    in_band = F.when(F.col("a.band") == 0, same[0]).when(F.col("a.band") == 1, ~same[0] & same[1]).otherwise(~same[0] & ~same[1] & same[2])
    first = F.floor(F.char_length("a.word") / 2).cast("int")
    heads = F.substring("a.word", F.lit(1), first) == F.substring("b.word", F.lit(1), first)
    in_half = F.when(F.col("a.half") == 0, heads).otherwise(~heads)
    flips = [F.bit_count(F.col(f"a.m{k}").bitwiseXOR(F.col(f"b.m{k}"))) for k in range(BANDS)]
    met = (F.col("a.key") == F.col("b.key")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.half") == F.col("b.half"))
    once = F.col("b.longer") | (F.col("a.word") < F.col("b.word"))
    edit = F.levenshtein("a.word", "b.word", 1) == 1
    pairs = a.join(b, met & once & (sum(flips[1:], flips[0]) <= 2) & in_band & in_half & edit)
    return pairs.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: the last word that forms lead to. Every round doubles the steps taken.

    Forms must not lead in a circle; words without a form (null) are their own root and are left out.
    """
    up = save(forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = F.col("further").isNotNull().alias("moved")
        new = save(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), moved))
        discard(up)
        up = new
        if not up.filter("moved").limit(1).count():
            return up.select("word", "root")


def spelling_groups(words: DataFrame, share: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for ``words(word, n)``.

    ``form`` is the most frequent near word (of equal ones the first in code-point order) if it is at least ``share`` times as
    frequent, else null; ``root`` is where forms lead. Every step multiplies the count, so forms end.
    """
    pairs = near_words(words)
    ways = [F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")]
    both = pairs.select(F.explode(F.array(*ways)).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near"))).alias("best"))
    fits = -F.col("best.n") >= share * F.col("n")
    form, form_n = F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")
    forms = save(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form, form_n))
    return forms.join(roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_report(docs: DataFrame) -> DataFrame:
    """:func:`spelling_groups` of the :func:`vocabulary` of ``docs(doc_id, text)``. No rows or no words: no rows."""
    return spelling_groups(save(vocabulary(docs)))


ORACLE = r"""
WITH RECURSIVE crc AS (SELECT i AS byte, i AS c, 0 AS k FROM (SELECT unnest(range(256)) AS i)
    UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc WHERE k < 8),
steps AS (SELECT list(c ORDER BY byte) AS step FROM crc WHERE k = 8),
runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
        unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents
),
lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (
    SELECT id, run, n, flatten(list_transform(string_split(id || ':' || run, ''),
        lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)) AS b
    FROM lowered
),
hashed AS (
    SELECT run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, step[xor(c & 255, x) + 1])), 4294967295) AS h
    FROM bytes, steps
),
cut AS (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, n
    FROM hashed
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
shorter AS (SELECT DISTINCT word, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM places),
holes AS (SELECT word, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole FROM places),
pairs AS (
    SELECT a.word AS word, b.word AS near FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
    UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.less = w.word
    UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.less = w.word
),
ranked AS (
    SELECT p.word, p.near, b.n, count(*) OVER (PARTITION BY p.word) AS n_near,
        row_number() OVER (PARTITION BY p.word ORDER BY b.n DESC, p.near) AS r
    FROM pairs p JOIN words b ON p.near = b.word
),
forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN near END AS form,
        CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
    FROM words w LEFT JOIN ranked r ON w.word = r.word AND r.r = 1
),
chain AS (
    SELECT word, word AS at, form AS next FROM forms
    UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN forms f ON c.next = f.word
)
SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
FROM forms f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""
