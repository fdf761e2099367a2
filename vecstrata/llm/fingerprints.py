"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame expressions only.

A text's paragraphs are its lines that are not empty; a line of over ``LONG_LINE``
characters is cut after each sentence besides.  A paragraph's digest are the first
60 bits of its MD5; a text has the set of its paragraphs' digests.

A sketch has three rows of eight cells.  A digest falls into one cell of each row,
and a cell holds how many digests fell into it, their exclusive or, and that of
their checks.  The sketches of two versions subtract cell by cell, which leaves the
digests that only one of them has.  A cell that holds a single digest, by its count
and its check, gives it away; it is taken out of its other cells, and so on
(peeling).  If all cells end empty, the difference is known.  If not, the digests
are sketched again in four sketches in place of one, each in the one that its next
two bits name; those that fail again are divided again, and so on; what is left after
the last time is compared as sets.

The fingerprint is the first sketch as text, cells joined by spaces, each as
count:digests:checks, so equal texts have equal fingerprints.  The likeness of two
fingerprints is the share of common digests among all of both, 1 if there are none.

The next document comes by position: rows are cut into ranges of (descending id,
hash of the text) by boundaries from a sorted pass over ids and hashes alone, the
first row of a range is also sent to the range before, and texts are shuffled once.

Defined cases: null texts are empty; null ids come last and repeated ids are ordered
by the hash of the text; a single row is its own next one; a repeated row has a result
for each; a text of any length is one row; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines longer than this are cut after sentences, too.
LONG_LINE = 1000
ROWS, WIDTH = 3, 8
#: Times that a sketch that fails is divided into four.
RETRIES = 10
#: Bytes of text that a range of documents has, about, and rows that it has at least on average.
RANGE, LEAST_ROWS = 1 << 24, 64

#: For each cell, from which bit on a digest's three bits are read in its row, and what they must say.
CELLS = "array(" + ", ".join(f"struct({20 + 3 * row} as bit, {column}L as says)" for row in range(ROWS) for column in range(WIDTH)) + ")"
DIFFERENCE = "struct<mine: int, theirs: int>"


def let(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def paragraphs(text: str) -> str:
    cut = f"transform(split({text}, '\\n'), x -> if(length(x) > {LONG_LINE}, split(x, '[.!?] '), array(x)))"
    return f"filter(flatten({cut}), x -> x <> '')"


def digests(text: str) -> str:
    """The distinct digests of a text's paragraphs."""
    return f"array_distinct(transform({paragraphs(text)}, x -> cast(conv(substring(md5(x), 1, 15), 16, 10) as bigint)))"


def check(x: str) -> str:
    """A 32-bit number that depends on a digest otherwise than by exclusive or."""
    return f"(({x} % 2147483647) * 1000003 + ({x} % 998244353) * 7919) % 4294967296"


def falls(x: str, cell: str) -> str:
    return f"shiftright({x}, {cell}.bit) & 7L = {cell}.says"


def sketch(items: str) -> str:
    """The cells (n, k, s) of a set of digests."""
    cell = f"struct(size(own) as n, aggregate(own, 0L, (h, x) -> h ^ x) as k, aggregate(own, 0L, (h, x) -> h ^ {check('x')}) as s)"
    return f"transform({CELLS}, cell -> {let(f'filter({items}, x -> {falls("x", "cell")})', 'own', cell)})"


def shown(cells: str) -> str:
    return f"array_join(transform({cells}, c -> concat(c.n, ':', c.k, ':', c.s)), ' ')"


def _single(cells: str) -> str:
    """The digests that some cell holds alone, with the side that they are of."""
    return f"array_distinct(transform(filter({cells}, c -> abs(c.n) = 1 and c.s = {check('c.k')}), c -> struct(c.n as n, c.k as k)))"


def peeled(mine: str, theirs: str) -> str:
    """How many digests only one of two sets has, from their sketches; null if not all cells empty."""
    apart = f"zip_with({sketch(mine)}, {sketch(theirs)}, (c, d) -> struct(c.n - d.n as n, c.k ^ d.k as k, c.s ^ d.s as s))"
    taken = let(
        f"filter(st.found, x -> {falls('x.k', 'cell')})", "out",
        f"struct(c.n - aggregate(out, 0, (h, x) -> h + x.n) as n, aggregate(out, c.k, (h, x) -> h ^ x.k) as k, aggregate(out, c.s, (h, x) -> h ^ {check('x.k')}) as s)",
    )
    rest = f"zip_with(st.cells, {CELLS}, (c, cell) -> {taken})"
    after = let(rest, "left", f"struct(left as cells, {_single('left')} as found, st.mine + size(filter(st.found, x -> x.n = 1)) as mine, st.theirs + size(filter(st.found, x -> x.n = -1)) as theirs)")
    begin = let(apart, "first", f"struct(first as cells, {_single('first')} as found, 0 as mine, 0 as theirs)")
    # a round without a single digest is the last; each other takes one out at least
    end = f"aggregate(sequence(1, {ROWS * WIDTH}), {begin}, (st, i) -> if(size(st.found) = 0, st, {after}))"
    done = f"if(forall(st.cells, c -> c.n = 0 and c.k = 0 and c.s = 0), struct(st.mine as mine, st.theirs as theirs), cast(null as {DIFFERENCE}))"
    return let(end, "st", done)


def difference(pair: str) -> str:
    """What only one of the sets ``pair.a`` and ``pair.b`` has: sketches, four for one after each failure, at the end the sets."""
    begin = f"array(struct({pair}.a as a, {pair}.b as b))"
    hopeless = f"abs(size(part.a) - size(part.b)) > {ROWS * WIDTH}"
    tried = let("part", "part", f"struct(part.a as a, part.b as b, if({hopeless}, cast(null as {DIFFERENCE}), {peeled('part.a', 'part.b')}) as d)")
    try_all = lambda parts: f"transform({parts}, part -> {tried})"
    quarter = lambda side: f"filter(whole.{side}, x -> shiftright(x, 2 * again - 2) & 3L = q)"
    quarters = f"flatten(transform(got.open, whole -> transform(array(0L, 1L, 2L, 3L), q -> struct({quarter('a')} as a, {quarter('b')} as b))))"
    parts = f"if(again = 0, got.open, {quarters})"
    known = "filter(made, m -> m.d is not null)"
    total = lambda side: f"got.{side} + aggregate({known}, 0, (n, m) -> n + m.d.{side})"
    left = "transform(filter(made, m -> m.d is null), m -> struct(m.a as a, m.b as b))"
    step = let(try_all(parts), "made", f"struct({left} as open, {total('mine')} as mine, {total('theirs')} as theirs)")
    zero = f"struct({begin} as open, 0 as mine, 0 as theirs)"
    end = f"aggregate(sequence(0, {RETRIES}), {zero}, (got, again) -> if(size(got.open) = 0, got, {step}))"
    rest = lambda x, y: f"aggregate(got.open, 0, (n, part) -> n + size(array_except(part.{x}, part.{y})))"
    return let(end, "got", f"struct(got.mine + {rest('a', 'b')} as mine, got.theirs + {rest('b', 'a')} as theirs, size(got.open) as compared)")


def likeness(mine: str, theirs: str) -> str:
    """The share of the digests of two sets that both have, from the difference of their sketches."""
    share = "if(size(pair.a) + d.theirs = 0, 1D, (size(pair.a) - d.mine) / (size(pair.a) + d.theirs))"
    return let(f"struct({mine} as a, {theirs} as b)", "pair", let(difference("pair"), "d", share))


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows(doc_id, text, ...)`` with next_<column>: those of the row after it by descending id, of the last the first's."""
    spark = rows.sparkSession
    key = [F.col("doc_id").isNull().alias("z"), F.bitwise_not("doc_id").alias("y"), F.xxhash64("text").alias("h")]
    placed = rows.select("*", F.struct(*key).alias("o"))
    slim = placed.select("o.*", F.octet_length("text").cast("bigint").alias("size"))
    total = slim.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    ranges = max(1, min(max(total.bytes // RANGE, 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))), total.n // LEAST_ROWS))
    first = slim.repartitionByRange(ranges, "z", "y", "h").groupBy(F.spark_partition_id().alias("of")).agg(F.min(F.struct("z", "y", "h")).alias("o")).collect()  # a row for each range
    starts = sorted((r.o for r in first), key=lambda o: (o.z, o.y or 0, o.h))
    step = max(1, math.isqrt(len(starts)))
    groups = [[tuple(o) for o in starts[k : k + step]] for k in range(0, len(starts), step)]
    kind = "struct<z: boolean, y: bigint, h: bigint>"
    tree = spark.createDataFrame([(groups,)], f"tree array<array<{kind}>>")
    found = placed.join(F.broadcast(tree)).withColumn("group", F.expr("size(filter(tree, g -> g[0] <= o))"))  # one row
    found = found.withColumn("place", F.expr("size(filter(tree[group - 1], b -> b <= o))")).withColumn("range", (F.col("group") - 1) * step + F.col("place") - 1)
    before = F.when(F.col("range") > 0, F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("guest"))).otherwise(F.struct(F.lit(len(starts) - 1).alias("range"), F.lit(2).alias("guest")))
    home = F.struct("range", F.lit(0).alias("guest"))
    where = F.when(F.expr("tree[group - 1][place - 1] = o"), F.array(home, before)).otherwise(F.array(home))
    dealt = found.select(*rows.columns, "o", F.explode(where).alias("at")).select(*rows.columns, "o", "at.*")
    order = Window.partitionBy("range").orderBy("guest", "o")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where("guest = 0").drop("o", "range", "guest")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of its characters replaced by the first ones of the next document.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = with_next(rows.withColumn("own", F.expr(digests("text"))), ["text", "own"]).withColumn("n_chars", F.length("text").cast("bigint"))
    half = "cast(n_chars div 2 as int)"
    made = both.withColumn("edited", F.expr(f"concat(substring(text, 1, cast(n_chars as int) - {half}), substring(next_text, 1, {half}))"))
    made = made.select("doc_id", "n_chars", "edited", "own", "next_own", F.expr(digests("edited")).alias("changed"))
    return made.select(
        "doc_id", "n_chars", "edited", F.expr(shown(sketch("own"))).alias("fingerprint"), F.expr(let("changed", "e", shown(sketch("e")))).alias("edited_fingerprint"),
        F.expr(likeness("own", "changed")).alias("near_edited"), F.expr(likeness("own", "next_own")).alias("near_next"),
    )
