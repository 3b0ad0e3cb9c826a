"""Operator 8, fuzzy line deduplication by MinHash; DataFrame operations only.

A line, trimmed and lower-cased, is the set of its character shingles: the SHINGLE characters from every position, in any
script; a line of fewer characters is one shingle. Lines of MIN_CHARS characters take part (those of scripts without
spaces count twice). Its signature is its BOTTOM least shingle hashes; every pair of them is a band key: lines of
similarity 0.8 share one with a probability of 0.99.

In each band a line is compared with the band's first line, that whose bands hold the most lines, and with the one before it: pairs whose signatures of SKETCH
hashes agree in half are verified by the exact Jaccard similarity of their whole sets, and verified pairs joined by a
distributed union-find. Of bands that still hold several components, those of up to SHORT_BAND lines are then paired in
full; the lines of longer ones meet on rare parts of their differences from the band's first line, which no similar pair
escapes: first each with the plainest line of its list, then those of different components, so that pairs do not grow with
the square of a band. Before that, lines of long bands whose sketches agree in half meet on the rarest hashes of these: lists of up
to SHORT_LIST lines are paired in full, and only lines of longer lists are cut into differences. Of every component the first occurrence stays, by id, then row, then
position; the others are removed.

Lines count once however often they occur: repeated ones are combined before each shuffle. Lines are known by 64-bit
hashes (collisions of the order of N*N/2**65 for N distinct lines). Recall against all pairs of whole shingle sets is
measured in tests/llm: at least 0.95 of the lines that go.

Defined results: null and empty texts have no lines that could go; shorter lines always stay, and lines under SHINGLE characters go only if equal; rows that repeat in id and
text are one document to the order and each kept alike; null ids come first; all columns of the input stay, and those of
the operator's internal names do not clash; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formweave.llm.common import among, forget, sifted, sifted_out, table, written
from formweave.llm.components import connected_components, merge_components

MIN_CHARS, SHINGLE, BOTTOM, SKETCH, SIMILAR = 6, 12, 4, 16, 0.8
LEAST = [f"m{k}" for k in range(BOTTOM)]
#: Lines in a band that are paired in full; those of longer bands meet on hashes of their sketches.
SHORT_BAND = 8
#: Lines with a hash of their sketches in common that are paired in full; those of longer lists meet on their differences.
SHORT_LIST = 32
#: Scripts whose words or syllables take a character or two: Thai, Lao, Tibetan, Myanmar, Khmer, the East Asian ones.
_DENSE = r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\ud7ff\uf900-\ufaff\uff66-\uffdc\x{20000}-\x{3ffff}]"
#: The shingles as a pattern; the operator cuts them by position, which costs half as much.
_STARTS = r"(?s)(?=(.{%d}|^.{1,%d}$))" % (SHINGLE, SHINGLE - 1)
#: The most that similar sets differ in, of their sizes taken together.
APART = (1 - SIMILAR) / (1 + SIMILAR)
#: Against rounding where a product should be whole.
TINY = 1e-6


def _lines(src: DataFrame) -> DataFrame:
    """(id, mark, pos, line_id, line) of the lines that take part; `src` is (id, mark, text)."""
    each = src.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    each = each.withColumn("line", F.lower(F.trim("line")))
    enough = F.length("line") >= MIN_CHARS
    enough |= (F.length("line") * 2 >= MIN_CHARS) & (F.length("line") + F.regexp_count("line", F.lit(_DENSE)) >= MIN_CHARS)
    each = each.where(enough)
    return each.withColumn("line_id", F.xxhash64("line"))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hashes(line: str) -> Column:
    """The hash of each shingle: in UTF-32 every character has four bytes, so a position is found without a scan."""

    def cut(u: Column) -> Column:
        last = F.greatest(F.length(u) - 4 * SHINGLE, F.lit(0)) + 1
        return F.transform(F.sequence(F.lit(1), last, F.lit(4)), lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * SHINGLE))))

    return _let(F.encode(line, "UTF-32"), cut)


def _shingles(line: str) -> Column:
    return F.array_distinct(_hashes(line))


def _least(line: str, count: int = BOTTOM) -> Column:
    """The least distinct hashes in order."""
    return _lowest(_shingles(line), count)


def _lowest(hashes: str | Column, count: int) -> Column:
    return F.slice(F.sort_array(hashes), 1, count)


def _signed(lines: DataFrame) -> DataFrame:
    """`lines` with m0, m1, ... for the line: its BOTTOM least distinct hashes, null where it has fewer; each is taken out before the
    next. The steps stand outside functions of elements, which are interpreted."""
    signed = lines.withColumn("hashes", _hashes("line")).drop("line")
    for m in LEAST:
        signed = signed.withColumn(m, F.array_min("hashes")).withColumn("hashes", F.array_remove("hashes", F.col(m)))
    return signed.drop("hashes")


def _signatures(lines: DataFrame) -> DataFrame:
    """(line_id, m0, m1, ...) of distinct lines."""
    return _signed(lines.select("line_id", "line")).distinct()


def _bands(signatures: DataFrame) -> DataFrame:
    """(key, line_id): a line's band keys, of the signatures of distinct lines."""
    pairs = [F.when(F.col(b).isNotNull(), F.xxhash64(a, b)) for i, a in enumerate(LEAST) for b in LEAST[i + 1 :]]
    alone = F.when(F.col(LEAST[1]).isNull(), F.xxhash64(LEAST[0], F.lit("alone")))
    return signatures.select("line_id", F.explode(F.array_compact(F.array(*pairs, alone))).alias("key"))


def _candidates(bands: DataFrame) -> DataFrame:
    """(a, b): each line with the first of its band and with the one before it."""
    w = Window.partitionBy("key").orderBy(F.desc("w"), "line_id")
    pairs = bands.select("line_id", F.first("line_id").over(w).alias("p"), F.lag("line_id").over(w).alias("q"))
    pairs = pairs.select(F.explode(F.array("p", "q")).alias("o"), "line_id").where("o <> line_id")
    return pairs.select(F.least("o", "line_id").alias("a"), F.greatest("o", "line_id").alias("b")).distinct()


def _alike() -> Column:
    """Whether lines of n_a and n_b shingles can be similar, and half of the least hashes of both taken together are in both sketches."""
    a, b = F.col("sketch_a"), F.col("sketch_b")
    both = F.array_intersect(a, b)
    union = F.least(F.size(a) + F.size(b) - F.size(both), F.lit(SKETCH))
    agree = 2 * F.size(F.array_intersect(both, _lowest(F.array_union(a, b), SKETCH))) >= union
    return _fits() & agree


def _fits() -> Column:
    return F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b") - TINY


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar; the hashes are made from the lines here, they are eight times as long, and the
    intersection makes sets of them. The verdict is exploded so that the optimizer can't move it, with the sets inlined in each place, into a filter."""
    a, b = (texts.select(*(F.col(c).alias(f"{c}_{s}") for c in texts.columns)).withColumnRenamed(f"line_id_{s}", s) for s in "ab")
    sets = pairs.join(b, "b").join(a, "a").where(_alike()).select("a", "b", "n_a", "n_b", _hashes("line_a").alias("sa"), _hashes("line_b").alias("sb"))
    sizes = sets.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    verdict = F.explode(F.array(F.col("both") >= SIMILAR * (F.col("n") - F.col("both"))))
    return sizes.select("a", "b", verdict.alias("similar")).where("similar").select("a", "b")


def _met(live: DataFrame, texts: DataFrame) -> DataFrame:
    """(token, x, c, n, k) of lines (line_id, c): the hashes of its sketch on which a line meets those of other components,
    k rows each.

    Sketches that agree in half share half of either, so they share one of the rarest hashes of each, as many as half of it
    and one more. Rare is what few lines have; what only lines of a single component have comes first and meets nothing."""
    lines = live.select("line_id", "c").distinct().join(texts.select("line_id", "n", "sketch"), "line_id").withColumnRenamed("line_id", "x")
    each = lines.select("x", "c", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("token"))
    across = [F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")]
    shared = each.groupBy("token").agg(*across).where("lo <> hi").select("token", "k")
    ordered = each.join(shared, "token").groupBy("x", "c", "n", "size").agg(F.sort_array(F.collect_list(F.struct("k", "token"))).alias("s"))
    own = F.col("size") - F.size("s")
    first = F.slice("s", F.lit(1), F.greatest(F.floor(F.col("size") / 2).cast("int") + 1 - own, F.lit(0)))
    rows = written(ordered.select("x", "c", "n", F.explode(first).alias("e")).select("x", "c", "n", F.col("e.token").alias("token")), "met")
    return rows.join(rows.groupBy("token").agg(*across).where("lo <> hi").select("token", "k"), "token")


def _differences(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(p, x, c, n, d, linked, tokens) of members (p, x, c): what only one of x and its centre p has, n shingles of x, d
    of the difference; `linked` where the two are similar."""
    x, p = (texts.select(F.col("line_id").alias(s), F.col("line").alias(f"line_{s}")) for s in "xp")
    sets = members.join(x, "x").join(p, "p").select("p", "x", "c", _shingles("line_x").alias("sx"), _shingles("line_p").alias("sp"))
    tokens = F.concat(F.array_except("sx", "sp"), F.array_except("sp", "sx"))
    found = sets.select("p", "x", "c", F.size("sx").alias("n"), F.size("sp").alias("np"), tokens.alias("tokens"))
    d = F.size("tokens")
    return found.select("p", "x", "c", "n", d.alias("d"), (d <= APART * (F.col("n") + F.col("np")) + TINY).alias("linked"), "tokens")


def _prefixes(found: DataFrame) -> DataFrame:
    """(p, x, c, n, d, linked, own, i, token): of the difference of each member its rarest tokens, `i` in their order.

    Two differences differ exactly where the lines do. Unless both lines link with the centre, similar ones share at
    least half of what their differences hold over the allowed distance: so they share one of the rarest, as many as the
    distance to the largest similar line, and half of that for the smaller difference. Rare is what few members of the
    centre have; the `own` tokens, which a single one has, come first and meet nothing."""
    each = found.select("p", "x", F.explode("tokens").alias("token"))
    shared = each.groupBy("p", "token").count().where("count > 1")
    ordered = each.join(shared, ["p", "token"]).groupBy("p", "x").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("s"))
    rows = ordered.join(found.drop("tokens"), ["p", "x"]).select("p", "x", "c", "n", "d", "linked", (F.col("d") - F.size("s")).alias("own"), F.posexplode("s").alias("k", "e"))
    rows = rows.select("p", "x", "c", "n", "d", "linked", "own", (F.col("own") + F.col("k")).alias("i"), F.col("e.token").alias("token"))
    return rows.where(F.col("i") <= F.floor(_most("n")))


def _most(n: str | Column) -> Column:
    """The most that a line of n shingles differs in from a similar one that is no smaller."""
    return (1 - SIMILAR) / SIMILAR * (F.col(n) if isinstance(n, str) else n) + TINY


def _could_be(u: str, v: str) -> Column:
    """Whether rows of prefixes that meet at a token, their first common one, could be of similar lines."""
    x, y = (lambda k: F.col(f"{u}.{k}")), (lambda k: F.col(f"{v}.{k}"))
    allowed = F.floor(APART * (x("n") + y("n")) + TINY)
    sizes = F.least(x("n"), y("n")) >= SIMILAR * F.greatest(x("n"), y("n")) - TINY
    return sizes & (2 * F.least(x("d") - x("i"), y("d") - y("i")) >= x("d") + y("d") - allowed)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _starred(rows: DataFrame) -> DataFrame:
    """(a, b): each member with that of its list, the members of one centre and token, which has the fewest tokens of its own
    and does not link with the centre: lines that share one difference from the centre are mostly similar to it."""
    heads = rows.groupBy("p", "token").agg(F.min_by(F.struct("x", "c", "n", "d", "i", "linked"), F.struct("linked", "own", "d", "x")).alias("h"))
    met = rows.alias("r").join(heads, ["p", "token"]).where("NOT h.linked AND r.x <> h.x AND r.c <> h.c")
    return met.where(_could_be("r", "h")).select(*_pair("r.x", "h.x")).distinct()


def _differing(rows: DataFrame, components: DataFrame) -> DataFrame:
    """(a, b): pairs of rows of prefixes that meet, are of different components and could be similar. In each list those of its
    largest component are not paired with each other, so that a group of similar lines costs no more than its strays."""
    named = rows.drop("c").join(components.select(F.col("line_id").alias("x"), "c"), "x", "left").withColumn("c", F.coalesce("c", "x"))
    sizes = named.groupBy("p", "token", "c").count().groupBy("p", "token")
    sizes = sizes.agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    named = written(named.join(sizes, ["p", "token"]).withColumn("stray", F.col("c") != F.col("main")), "prefixes")
    first = named.where(F.col("i") <= F.floor(_most("n") / 2))

    def met(u: DataFrame, v: DataFrame) -> DataFrame:
        on = F.expr("u.p = v.p AND u.token = v.token AND u.c <> v.c AND u.d <= v.d")
        return u.alias("u").join(v.alias("v"), on & _could_be("u", "v")).select(*_pair("u.x", "v.x"))

    return met(first.where("stray"), named).unionByName(met(first.where("NOT stray"), named.where("stray"))).distinct()


def _left_over(bands: DataFrame, texts: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The similar pairs (a, b) of different components in short bands, in short lists of a hash of the sketches, with the centres of
    long bands and with the heads of the lists of their differences; the prefixes of the members of long bands and lists;
    and the texts of the lines in question."""
    named = bands.join(components, "line_id", "left").withColumn("c", F.coalesce("c", "line_id"))
    several = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("line_id", F.struct("w", F.bitwise_not("line_id"))).alias("p"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 3 AND lo <> hi").select("key", "n", "p")
    live = written(named.join(several, "key"), "bands")
    texts = written(among(texts, "line_id", live.select("line_id")), "lines")
    x, y = (live.where(F.col("n") <= SHORT_BAND).alias(s) for s in "xy")
    short = x.join(y, F.expr("x.key = y.key AND x.c <> y.c AND x.line_id < y.line_id")).select(F.col("x.line_id").alias("a"), F.col("y.line_id").alias("b"))
    long = live.where(F.col("n") > SHORT_BAND)
    met = written(_met(long, texts), "met")
    u, v = (met.where(F.col("k") <= SHORT_LIST).select("token", *(F.col(c).alias(f"{c}_{s}") for c in "xcn")) for s in "ab")
    listed = u.join(v, "token").where((F.col("c_a") != F.col("c_b")) & (F.col("x_a") < F.col("x_b")) & _fits()).select(F.col("x_a").alias("a"), F.col("x_b").alias("b"))
    members = long.where("p <> line_id").select("p", F.col("line_id").alias("x"), "c").distinct().join(met.where(F.col("k") > SHORT_LIST).select("x").distinct(), "x")
    found = written(_differences(members, texts), "differences")
    linked = found.where("linked").select(*_pair("p", "x"))
    rows = written(_prefixes(found), "prefixes")
    pairs = short.unionByName(listed).unionByName(_starred(rows)).distinct()
    return _similar(pairs, texts).unionByName(linked), rows, texts


def line_components(lines: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """(line_id, component) of distinct lines that have a similar one; `signatures` of them, if they have been made."""
    w = Window.partitionBy("key")
    bands = written(_bands(_signatures(lines) if signatures is None else signatures).withColumn("n", F.count(F.lit(1)).over(w)).where("n > 1"), "bands")
    # the line whose bands hold the most is the first of its bands: what is similar in a group is mostly similar to it
    weights = bands.groupBy("line_id").agg(F.sum("n").alias("w"))
    bands = written(bands.drop("n").join(weights, "line_id"), "bands")
    wanted = bands.select("line_id").distinct()
    chosen = sifted(lines.select("line_id", "line"), "line_id", wanted).join(wanted, "line_id")  # a semi-join would be moved before it
    texts = chosen.groupBy("line_id").agg(F.min("line").alias("line")).withColumn("shingles", _shingles("line"))
    texts = written(texts.select("line_id", "line", F.size("shingles").alias("n"), _lowest("shingles", SKETCH).alias("sketch")), "lines")
    found = connected_components(written(_similar(_candidates(bands), texts), "edges"))
    near, rows, few = _left_over(bands, texts, _named(found))
    found = written(merge_components(found, written(near, "edges")), "components")
    rest = written(_similar(_differing(rows, _named(found)), few), "edges")
    if not rest.isEmpty():
        found = merge_components(found, rest)
    for t in (bands, texts):
        forget(t)
    return found.select(F.col("node").alias("line_id"), "component")


def _named(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("line_id"), F.col("component").alias("c"))


def removals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, gone): for every document that loses lines their positions; `mark` is the hash of its text."""
    src = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    lines = _lines(src)
    signed = written(_signed(lines), "signed")
    components = written(line_components(lines, signed.select("line_id", *LEAST).distinct()), "components")
    # a line that comes once and has no similar one stays, and need not meet any other
    repeated = signed.groupBy("line_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("line_id")
    wanted = written(repeated.unionByName(components.select("line_id")), "wanted")
    occurrences = among(signed.select("id", "mark", "pos", "line_id"), "line_id", wanted).join(components, "line_id", "left")
    occurrences = written(occurrences.select("id", "mark", "pos", F.coalesce("component", "line_id").alias("c")), "occurrences")
    for t in (signed, components, wanted):
        forget(t)
    heads = occurrences.groupBy("c").agg(F.min(F.struct("id", "mark", "pos")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "head")
    gone = occurrences.join(heads, "c").where(F.struct("id", "mark", "pos") != F.col("head"))
    return gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone"))


def _with_removals(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`df` with _fw_gone, the positions of removed lines or null. Texts that lose nothing are not shuffled."""
    gone = removals(df.select(id_col, text_col), id_col, text_col)
    gone = written(gone.select(F.col("id").alias("_fw_id"), F.col("mark").alias("_fw_mark"), F.col("gone").alias("_fw_gone")), "gone")
    marked, marks = df.withColumn("_fw_own", F.xxhash64(text_col)), gone.select(F.col("_fw_mark").alias("_fw_own"))
    on = F.col(id_col).eqNullSafe(F.col("_fw_id")) & (F.col("_fw_own") == F.col("_fw_mark"))
    losing = sifted(marked, "_fw_own", marks).join(gone, on, "left").drop("_fw_id", "_fw_mark")
    whole = sifted_out(marked, "_fw_own", marks).withColumn("_fw_gone", F.lit(None).cast("array<int>"))
    return losing.unionByName(whole).drop("_fw_own")


def _cleaned(text_col: str) -> Column:
    kept = F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains(F.col("_fw_gone"), i))
    return F.when(F.col("_fw_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))


def dedup_lines(df: DataFrame, id_col: str, text_col: str, chars_col: str | None = None) -> DataFrame:
    """The rows of `df`, all columns, their texts without removed lines and `chars_col` counted anew."""
    out = _with_removals(df, id_col, text_col).withColumn(text_col, _cleaned(text_col)).drop("_fw_gone")
    if chars_col:
        out = out.withColumn(chars_col, F.length(text_col).cast(df.schema[chars_col].dataType))
    return out.select(df.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = _cleaned("text")
    return _with_removals(docs, "doc_id", "text").select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(F.col("_fw_gone").isNull(), 0).otherwise(F.size("_fw_gone")).cast("long").alias("n_removed"),
        text.alias("text"),
    )
