r"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is its set of words (between spaces and tabs).  Of lines whose sets have a Jaccard similarity
of SIMILAR or more, later ones go; order is by (doc_id, line number).

Equal lines are found by hash.  The others: words are ordered by rarity (counts of all words, in
2^CELL_BITS hash cells; any one order gives the same result), and a line is listed under its rarest
words, as many as two similar lines cannot both avoid.  Under a word that stands FREQUENT times or
more it is listed together with each word that may be the second one shared: two similar lines
share two words at least, and the second is not far behind.  So no list is as long as a frequent
word's count.  Two lines of a list are candidates if their lengths, the places of the word in both
orders, and a 128-bit parity of their words allow the similarity; they are verified on their words.

Whether a line goes takes one earlier match only.  So each list of GROUP rows or more is first held
against its earliest line, and what GROUP lines or more may match in this way is verified; only lines that this did not
remove are then held against all earlier lines of their lists.  A large group of variants of one line
thus costs its size, not its square.  A line meets only those lines of a list whose sizes, in bands,
allow the similarity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.storage import bucketed, drop, held, light, own, written

#: Lines with fewer words stay: 1 leaves out none but blank ones.
MIN_WORDS = 1
#: Jaccard similarity as a fraction.
SIMILAR = (3, 4)
#: The table of ranks has 8 bytes for each of 2^CELL_BITS cells, whatever the input.
CELL_BITS = 18
#: Tokens hold a word's rank above so many bits of its hash; ranks are under 256, so tokens are never negative.
RANK_SHIFT = 55
#: Words of so many occurrences are listed in pairs.
FREQUENT = 1 << 13
#: Lines that equal so many others are joined apart from the rest.
COMMON = 1000
#: Lines that may match one earlier line are a group from this number on; fewer are held against all of their lists at once.
GROUP = 16
#: From so many pairs a line, wide parities are held against each other before words.
MANY = 4
#: Lists of so many rows a bucket are joined in memory; longer ones by sorting.
IN_MEMORY = 1 << 20


def _words(line: Column) -> Column:
    return F.array_remove(_pieces(line), "")


def _pieces(line: Column) -> Column:
    """Words, and empty strings where white space meets; few lines have tabs or returns to replace."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r"))
    plain = F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.split(F.when(odd, plain).otherwise(line), " ")


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, line`` of lines with MIN_WORDS words or more."""
    # a line has a word if anything is left between its outer white space: no need to count words.  Taking off
    # spaces looks at the ends only, taking off a set of characters at all of the line: few lines need that
    some = F.when(F.ascii(F.trim("line")) > 32, True).otherwise(F.btrim("line", F.lit(" \t\r")) != "")
    enough = some if MIN_WORDS == 1 else F.size(_words(F.col("line"))) >= MIN_WORDS
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(enough)


def _repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no`` of lines that an earlier line equals.

    Lines that stand very often are few: they are joined by broadcast, apart from the others, so that
    no task gets all places of one line.
    """
    lines = written(_lines(docs).select("doc_id", "line_no", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2")), "lines")
    place = _place(lines)
    first = lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first, "lines-classes")
    parts = [light(first)]
    if parts[0] is first:
        common = written(first.where(F.col("n") >= COMMON), "lines-common")
        parts = [light(common), first.where(F.col("n") < COMMON)]
    out = None
    for part in parts:
        found = lines.join(part, ["h", "h2"]).where(place > F.col("first")).select("doc_id", "line_no")
        out = found if out is None else out.unionByName(found)
    out = written(out, "lines-equal")
    drop(lines, first)
    return out


def _place(lines: DataFrame) -> Column:
    """What ascends with (doc_id, line_no) and differs for each: one number where it holds both, as its least is found by hash aggregation."""
    most = lines.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("line_no").alias("line")).first()
    least = int(most["least"] or 0)
    if (int(most["most"] or 0) - least).bit_length() > 39 or (most["line"] or 0) >= 1 << 24:
        return F.struct("doc_id", "line_no")
    return F.shiftleft(F.col("doc_id").cast("long") - F.lit(least).cast("long"), 24) + F.col("line_no").cast("long")


def _ranks(docs: DataFrame) -> DataFrame:
    """One row with 4 * log2 of each hash cell's count of words, as an array of longs that hold it above RANK_SHIFT bits."""
    cell = F.xxhash64("w").bitwiseAND(F.lit((1 << CELL_BITS) - 1)).cast("int")
    counts = docs.select(F.explode(F.split("text", " ")).alias("w")).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"))
    every = docs.sparkSession.range(1 << CELL_BITS).select(F.col("id").cast("int").alias("cell"), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(every).groupBy("cell").agg(_rank(F.greatest(F.sum("n"), F.lit(1))).alias("rank"))
    # one task holds the whole table: its size does not depend on the input
    table = full.agg(F.transform(F.sort_array(F.collect_list(F.struct("cell", "rank"))), lambda x: F.shiftleft(x["rank"].cast("long"), RANK_SHIFT)).alias("ranks"))
    return written(table, "word-ranks", conf={"spark.sql.codegen.aggregate.fastHashMap.capacityBit": str(CELL_BITS)})


def _rank(n: Column) -> Column:
    # 252 at most, at 2^63 words
    return F.floor(4 * F.log2(n)).cast("smallint")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` with a column ``_gone``: sorted numbers of the lines in ``gone`` (null: none)."""
    by_doc = written(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line_no")).alias("_gone")).withColumnRenamed("doc_id", "_doc"), "lines-gone")
    return docs.join(light(by_doc), F.col("doc_id") == F.col("_doc"), "left").drop("_doc")


def _listed(docs: DataFrame, gone: DataFrame, ranks: DataFrame) -> DataFrame:
    """``token, doc_id, line_no, size, parity, more``: lines under their rarest words, or pairs of words.

    size packs the number of distinct words and the word's place in their order, 32 bits each.
    """
    rest = _without(docs.select("doc_id", "text"), gone)
    lines = rest.select("doc_id", "_gone", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.where(F.col("_gone").isNull() | ~F.array_contains("_gone", F.col("line_no")))
    hashes = F.array_remove(F.array_distinct(F.transform(_pieces(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    # a projection of its own, as the next one reads its column twice: inside of a transform array_distinct would not be compiled
    lines = lines.select("doc_id", "line_no", hashes.alias("hashes")).select("doc_id", "line_no", "hashes", F.size("hashes").alias("n"))
    # the ranks come in above the hashes, in one projection with what reads them: no row ever carries them
    lines = lines.withColumn("_ranks", ranks.scalar())
    # never null, so that arrays of them sort as plain numbers
    rank = lambda h: F.coalesce(F.get("_ranks", h.bitwiseAND(F.lit((1 << CELL_BITS) - 1))), F.lit(0).cast("long"))
    token = lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, 64 - RANK_SHIFT))
    lines = lines.select("doc_id", "line_no", F.sort_array(F.transform("hashes", token)).alias("tokens"), "n")
    lines = lines.withColumns({"parity": _parity(0), "more": _parity(1)})
    a, b = SIMILAR
    # of two similar lines neither has more than n - prefix + 1 words that the other lacks; lines of one or two words only match equal sets
    prefix = F.when(F.col("n") < MIN_WORDS, 0).when(F.col("n") < 3, 1).otherwise(F.expr(f"n - (({a} * n + {b - 1}) div {b}) + 1")).cast("int")
    out = lines.withColumn("prefix", prefix)
    out = out.select("doc_id", "line_no", "n", "parity", "more", "prefix", "tokens", F.posexplode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("place", "t"))
    often = (F.shiftright("t", RANK_SHIFT) >= _rank(F.lit(FREQUENT))) & (F.col("n") >= 3)
    second = F.when(often, F.sequence(F.col("place") + 1, F.col("prefix"))).otherwise(F.array(F.col("place") + 1))
    out = out.select("doc_id", "line_no", "n", "parity", "more", "tokens", "place", "t", often.alias("often"), F.explode(second).alias("second"))
    key = F.when(F.col("n") < 3, F.xxhash64("tokens")).when(F.col("often"), F.xxhash64("t", F.get("tokens", F.col("second")))).otherwise(F.col("t"))
    # at the first pair shared, what follows in both is counted from the place before the second word
    size = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("second") - 1).cast("long"))
    # 31 bits of the key are enough to list by: words that share them only make more candidates
    short = key.bitwiseXOR(F.shiftright(key, 32)).bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
    return out.select(short.alias("token"), "doc_id", "line_no", size.alias("size"), "parity", "more")


def _parity(half: int) -> Column:
    """Half of a 128-bit parity: of the tokens whose seventh bit is ``half``."""
    # a shift takes its distance modulo 64
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 37).cast("int"))
    own = F.lit(half << 36).cast("long")
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: F.when(t.bitwiseAND(F.lit(1 << 36)) == own, a.bitwiseXOR(bit(t))).otherwise(a))


def _apart() -> Column:
    """At least so many words are in one line only: bits in which two parities differ."""
    return F.bit_count(F.col("parity").bitwiseXOR(F.col("parity2"))) + F.bit_count(F.col("more").bitwiseXOR(F.col("more2")))


def _may_match() -> Column:
    """Of rows x (``size, parity``) and y (``size2, parity2``) of one list: do lengths, places and parities allow the similarity?

    At the first word two similar lines share, what follows it in both must be enough.
    """
    a, b = SIMILAR
    nx, ny = F.shiftright("size", 32), F.shiftright("size2", 32)
    i, j = F.col("size").bitwiseAND(F.lit((1 << 32) - 1)), F.col("size2").bitwiseAND(F.lit((1 << 32) - 1))
    lengths = (b * F.least(nx, ny) >= a * F.greatest(nx, ny))
    places = (a + b) * F.least(nx - i, ny - j) >= a * (nx + ny)
    parities = (a + b) * (nx + ny - _apart()) >= 2 * a * (nx + ny)
    return lengths & parities & places


def _band(n: Column) -> Column:
    """A number that never falls as ``n`` grows: five to an octave."""
    return F.floor(5 * F.log2(n)).cast("int")


def _bands() -> Column:
    """The bands of all sizes that a row (``size``) may match by lengths and by its own place, as an array."""
    a, b = SIMILAR
    n, i = F.shiftright("size", 32), F.col("size").bitwiseAND(F.lit((1 << 32) - 1))
    least = F.expr(f"({a} * shiftright(size, 32) + {b - 1}) div {b}")
    # (a + b) * (n - i) >= a * (n + m), and no more than lengths allow as i is 0 at least
    most = F.floor((b * n - (a + b) * i) / a)
    return F.when(most >= least, F.sequence(_band(least), _band(most)))


def _texts(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """``doc_id, line_no, words``: the lines of ``pairs`` with their distinct words."""
    ids = pairs.select("doc_id", "line_no").unionByName(pairs.select(F.col("doc2").alias("doc_id"), F.col("line2").alias("line_no"))).distinct()
    wanted = written(ids.groupBy("doc_id").agg(F.collect_set("line_no").alias("_want")).withColumnRenamed("doc_id", "_doc"), name + "-wanted")
    texts = docs.select("doc_id", "text").join(light(wanted), F.col("doc_id") == F.col("_doc"))
    lines = texts.select("doc_id", "_want", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.array_contains("_want", F.col("line_no")))
    words = lines.select("doc_id", "line_no", F.array_distinct(_words(F.col("line"))).alias("words")).dropDuplicates(["doc_id", "line_no"])
    words = written(words, name + "-words")
    drop(wanted)
    return words


def _matched(pairs: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """``doc_id, line_no`` of each later line of the written table ``pairs`` (doc_id, line_no, doc2, line2) that is similar enough."""
    a, b = SIMILAR
    near = pairs
    right = words.select(F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"), F.col("words").alias("y"))
    if pairs.count() >= MANY * words.count():
        near = _near(pairs, words, name)
        # the lines that a pair names, and no others, go through the shuffle
        right = right.join(light(written(near.select("doc2", "line2").distinct(), name + "-wanted")), ["doc2", "line2"], "left_semi")
    left = words.select("doc_id", "line_no", F.col("words").alias("x")).join(light(near), ["doc_id", "line_no"])
    # both / (x + y - both) >= a / b, with one intersection
    out = left.join(right, ["doc2", "line2"]).where((a + b) * F.size(F.array_intersect("x", "y")) >= a * (F.size("x") + F.size("y")))
    out = written(out.select("doc_id", "line_no").distinct(), name)
    if near is not pairs:
        drop(near)
    return out


def _near(pairs: DataFrame, words: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs`` that 256-bit parities of their words do not refute: 32 bytes of each line."""
    a, b = SIMILAR
    # 31 bits of a hash, so that shifts of it are whole numbers
    signs = words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 31) - 1))))
    signs = written(signs.select("doc_id", "line_no", F.size("words").alias("n"), *[_sign(k).alias(f"s{k}") for k in range(4)]), name + "-signs")
    other = signs.select(F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"), F.col("n").alias("n2"), *[F.col(f"s{k}").alias(f"t{k}") for k in range(4)])
    apart = sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"t{k}"))) for k in range(4)), F.lit(0))
    near = signs.join(light(pairs), ["doc_id", "line_no"]).join(other, ["doc2", "line2"])
    near = near.where((a + b) * (F.col("n") + F.col("n2") - apart) >= 2 * a * (F.col("n") + F.col("n2"))).select("doc_id", "line_no", "doc2", "line2")
    near = written(near, name + "-near")
    drop(signs)
    return near


def _sign(k: int) -> Column:
    """A quarter of a 256-bit parity of ``hashes``."""
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 9).cast("int"))
    return F.aggregate("hashes", F.lit(0).cast("long"), lambda t, h: F.when(F.shiftright(h, 7).bitwiseAND(F.lit(3)) == k, t.bitwiseXOR(bit(h))).otherwise(t))


def _order(docs: DataFrame) -> Column:
    """One number that ascends with (doc_id, line_no).

    Documents share one only where ids spread over more than 2^39, lines only beyond 2^24 of a document:
    a list then has more than one earliest line, which costs time and changes no result.
    """
    ids = docs.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    least, most = int(ids["least"] or 0), int(ids["most"] or 0)
    shift = max(0, (most - least).bit_length() - 39)
    doc = F.shiftright(F.col("doc_id").cast("long"), shift) - F.lit(least >> shift).cast("long")
    return F.shiftleft(doc, 24) + F.least(F.col("line_no"), F.lit((1 << 24) - 1)).cast("long")


def later_matches(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no`` (from 0) of all lines to remove, some more than once."""
    ids = docs.select("doc_id")
    docs = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    equal = _repeated(docs)
    ranks = _ranks(docs)
    listed = bucketed(_listed(docs, equal, ranks), "lists", "token")
    drop(ranks)
    line = ["doc_id", "line_no", "size", "parity", "more"]
    later = (F.col("doc_id") > F.col("doc2")) | ((F.col("doc_id") == F.col("doc2")) & (F.col("line_no") > F.col("line2")))
    pair = ("doc_id", "line_no", "doc2", "line2")

    # a least number can be aggregated by hash, in compiled code; a least struct, or one with all that a line has, cannot
    order = _order(ids)
    first = listed.groupBy(F.col("token").alias("token2")).agg(F.min(order).alias("o"), F.count("*").alias("rows")).where(F.col("rows") >= GROUP)
    first = listed.join(first, F.col("token") == F.col("token2")).where(order <= F.col("o"))  # an equality would become a key of the join, by which the lists are not dealt
    first = first.select("token2", F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"), F.col("size").alias("size2"), F.col("parity").alias("parity2"), F.col("more").alias("more2"))
    early = listed.join(first, F.col("token") == F.col("token2")).where(later & _may_match()).select(*pair).distinct()
    early = written(early, "lines-early", sorted_buckets=True)
    groups = written(early.groupBy("doc2", "line2").count().where(F.col("count") >= GROUP).select("doc2", "line2"), "lines-groups")
    early = written(early.join(light(groups), ["doc2", "line2"], "left_semi").select(*pair), "lines-early")
    words = _texts(early, docs, "lines-early")
    gone = _matched(early, words, "lines-first")
    drop(early, words)

    done = light(gone.select(F.col("doc_id").alias("_d"), F.col("line_no").alias("_l")))
    open_ = listed.join(done, (F.col("doc_id") == F.col("_d")) & (F.col("line_no") == F.col("_l")), "left_anti")
    all_ = listed.select(F.col("token").alias("token2"), F.col("doc_id").alias("doc2"), F.col("line_no").alias("line2"), F.col("size").alias("size2"), F.col("parity").alias("parity2"), F.col("more").alias("more2"))
    open_ = open_.withColumn("band", F.explode(_bands()))
    all_ = all_.withColumn("band2", _band(F.shiftright("size2", 32)))
    if listed.count() <= IN_MEMORY * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        all_ = all_.hint("shuffle_hash")
    rest = open_.join(all_, (F.col("token") == F.col("token2")) & (F.col("band") == F.col("band2"))).where(later & _may_match()).select(*pair, _apart().alias("apart")).distinct()
    # lists are dealt by token alone
    rest = written(rest, "lines-open", sorted_buckets=True, conf={"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    drop(listed)
    words = _texts(rest, docs, "lines-rest")
    if rest.count() < MANY * words.count():
        more = _matched(rest.select(*pair), words, "lines-more")
        drop(rest, words)
        return equal.unionByName(gone).unionByName(more)
    # the likeliest match of each line first, the others for lines that it did not remove
    best = rest.groupBy("doc_id", "line_no").agg(F.min(F.struct("apart", "doc2", "line2")).alias("b")).select("doc_id", "line_no", "b.doc2", "b.line2")
    best = written(best, "lines-likeliest")
    more = _matched(best, words, "lines-best")
    tried = best.withColumn("tried", F.lit(True))
    still = rest.select(*pair).join(light(more), ["doc_id", "line_no"], "left_anti").join(tried, list(pair), "left").where("tried is null").drop("tried")
    still = written(still, "lines-still")
    more = more.unionByName(_matched(still, words, "lines-more"))
    drop(rest, words, best, still)
    return equal.unionByName(gone).unionByName(more)


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` without later matches, ``n_lines`` and ``n_removed`` (own columns of these two names go).

    Null texts stay null, with 0 lines; an empty text has one empty line.  Rows that repeat a doc_id
    are one document whose lines have the same numbers, and lose the same ones; a line is never
    a later match of itself.  Rows without a doc_id are left as they are.  Lines that are equal as
    sets match.  Own columns may have any name.  An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    out = _without(held(docs, "doc_id", "text"), later_matches(docs))
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda line, i: ~F.array_contains("_gone", i)), "\n")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text")
    columns = [text if c == "text" else x for c, x in zip(docs.columns, own(docs.columns, "doc_id", "text"), strict=True)]
    removed = F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)).cast("long")
    return out.select(*columns, n.alias("n_lines"), removed.alias("n_removed"))


def keep_new_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without later lines, n_chars counted anew; documents that lose all of their text go."""
    out = deduplicated(docs).where("n_removed = 0 or text <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")])
