"""Queries of the timeline operators over the driver's tables, with SQL for each that SQL can express.

The tables stand in for model output: events are intervals of their value in minutes, their users media,
their types labels; purchases and signups are speaker turns; embeddings are class probabilities of frames;
conversations are transcripts, their roles speakers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.functions import text as T
from chronoweave.operators import assemble, frames, intervals, regions, segments, speakers, turns

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t, epoch_us(ts) // 1000 + round(value * 60000)::BIGINT AS e FROM events)"
TURN = "tu AS (SELECT user_id % 10 AS media_id, event_id AS ord, t AS start_ms, e AS end_ms, 'spk_' || (user_id % 4) AS speaker_id FROM ev WHERE event_type IN ('purchase', 'signup'))"
SPAN = "sp AS (SELECT user_id % 10 AS media_id, event_id AS span_id, t AS start_ms, e AS end_ms FROM ev WHERE event_type NOT IN ('purchase', 'signup'))"
PROB = "pr AS (SELECT media_id, 0 AS \"window\", frame, c - 1 AS class, ((embedding[c]::DOUBLE + 1) / 2)::FLOAT AS prob FROM (SELECT vec_id // 250 AS media_id, vec_id % 250 AS frame, embedding, unnest(range(1, len(embedding) + 1)) AS c FROM embeddings))"
MEDIA = "me AS (SELECT user_id AS media_id, max(e) - min(t) AS duration_ms FROM ev GROUP BY user_id)"
#: Python's str.strip over the white space that the texts have.
_STRIP = r"regexp_replace({0}, '^[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}]+|[\x09-\x0D\x1C-\x20\x{{85}}\x{{A0}}]+$', '', 'g')"


def query(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "events")
    t = S.ntz_millis(F.col("ts"))
    return e.select("event_id", "user_id", "event_type", "value", t.alias("t"), (t + F.rint(F.col("value") * 60000).cast("long")).alias("e"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where(F.col("event_type").isin("purchase", "signup"))
    return e.select((F.col("user_id") % 10).alias("media_id"), F.col("event_id").alias("ord"), F.col("t").alias("start_ms"), F.col("e").alias("end_ms"), F.concat(F.lit("spk_"), F.col("user_id") % 4).alias("speaker_id"))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d).where(~F.col("event_type").isin("purchase", "signup"))
    return e.select((F.col("user_id") % 10).alias("media_id"), F.col("event_id").alias("span_id"), F.col("t").alias("start_ms"), F.col("e").alias("end_ms"))


def _sounds(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    label_class = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(["click", "error", "purchase", "signup", "view"]) for x in (k, i)]), F.col("event_type"))
    return e.select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), F.col("t").alias("start_ms"), F.col("e").alias("end_ms"), F.col("event_type").alias("label"), label_class.alias("class"), (F.col("value") / 500).alias("score"), (F.col("value") > 100).alias("prompt_relevant"))


def _probs(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 250).cast("long").alias("media_id"), (F.col("vec_id") % 250).alias("frame"), F.posexplode("embedding").alias("class", "x"))
    return e.select("media_id", F.lit(0).alias("window"), "frame", "class", ((F.col("x").cast("double") + 1) / 2).cast("float").alias("prob"))


def _media(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).groupBy(F.col("user_id").alias("media_id")).agg((F.max("e") - F.min("t")).alias("duration_ms"))


# --- events and frames -------------------------------------------------------------------------------

MERGED = """
a AS (SELECT user_id AS media_id, event_id AS ord, t, e, event_type AS label, value / 500 AS score, value > 100 AS rel,
        CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS turn FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
b AS (SELECT *, sum(turn) OVER (PARTITION BY media_id ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS run FROM a),
c AS (SELECT *, max(e) OVER (PARTITION BY media_id, run ORDER BY t, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
d AS (SELECT *, sum(CASE WHEN before IS NULL OR t - before > 21600000 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, run ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS isle FROM c),
mg AS (SELECT media_id, min(t) AS start_ms, max(e) AS end_ms, any_value(label) AS label, max(score) AS score, bool_or(rel) AS prompt_relevant FROM d GROUP BY media_id, run, isle)"""


@query(f"WITH {EV}, {MERGED} SELECT * FROM mg")
def w6_merge_events(spark, d):
    return frames.merged(_sounds(spark, d), 21_600_000).drop("class")


ACTIVE = "ac AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, \"window\", frame ORDER BY prob DESC, class) AS r FROM pr) WHERE r <= 3 AND prob >= 0.6::FLOAT)"


@query(f"WITH {PROB}, {ACTIVE} SELECT media_id, frame, class, prob::DOUBLE AS prob FROM ac")
def p3_o5_active_classes(spark, d):
    return frames.active(_probs(spark, d), 0.6, 3).select("media_id", "frame", "class", F.col("prob").cast("double").alias("prob"))


RUNS = """
ru AS (SELECT *, CASE WHEN frame - lag(frame) OVER w <= 31 THEN 0 ELSE 1 END AS new FROM ac WINDOW w AS (PARTITION BY media_id, class ORDER BY frame)),
rs AS (SELECT media_id, class, min(frame) AS first, max(frame) + 1 AS past FROM (SELECT *, sum(new) OVER (PARTITION BY media_id, class ORDER BY frame ROWS UNBOUNDED PRECEDING) AS isle FROM ru) GROUP BY media_id, class, isle)"""


@query(f"WITH {PROB}, {ACTIVE}, {RUNS} SELECT * FROM rs")
def w4_frame_runs(spark, d):
    return frames.runs(frames.active(_probs(spark, d), 0.6, 3), 30).select("media_id", "class", "first", "past")


@query(
    f"""WITH {PROB}, {ACTIVE}, {RUNS},
    nm AS (SELECT rs.*, coalesce(n_name, class::VARCHAR) AS label FROM rs LEFT JOIN nation ON n_nationkey = class),
    ev AS (SELECT nm.media_id, nm.class, label, first * 20 AS start_ms, past * 20 AS end_ms, round(max(prob)::DOUBLE, 3) AS score
           FROM nm JOIN pr ON pr.media_id = nm.media_id AND pr.class = nm.class AND frame >= first AND frame < past WHERE (past - first) * 20 >= 60 GROUP BY ALL)
    SELECT *, lower(label) IN ('nation_3', '40') AS prompt_relevant FROM ev"""
)
def w5_frame_events(spark, d):
    names = _table(spark, d, "nation").select(F.col("n_nationkey").alias("class"), F.col("n_name").alias("label"))
    return frames.events(_probs(spark, d), 20, names, 0.6, 3, 600, 60, True, ("NATION_3", "40", " ")).drop("window")


@query(f"WITH {PROB} SELECT media_id, class, max(prob)::DOUBLE AS score, 20 * arg_min(frame, (-prob, frame)) AS at_ms FROM pr GROUP BY media_id, class")
def a7_class_peaks(spark, d):
    return frames.peaks(_probs(spark, d), 20).select("media_id", "class", F.col("score").cast("double").alias("score"), "at_ms")


@query(
    f"""WITH {PROB}, pw AS (SELECT media_id // 4 AS media_id, media_id % 4 AS w, class, max(prob) AS score, 20 * arg_min(frame, (-prob, frame)) AS at_ms FROM pr GROUP BY ALL),
    b AS (SELECT media_id, class, max(score)::DOUBLE AS score, arg_max(at_ms, (score, -w)) AS at_ms FROM pw GROUP BY media_id, class)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, class) AS rank FROM b) WHERE rank <= 10"""
)
def a8_o6_top_peaks(spark, d):
    p = frames.peaks(_probs(spark, d), 20)
    p = p.withColumns({"window": F.col("media_id") % 4, "media_id": F.floor(F.col("media_id") / 4)})
    return frames.best_peaks(p, 10).withColumn("score", F.col("score").cast("double"))


@query(
    f"""WITH {PROB}, w AS (SELECT DISTINCT media_id FROM pr)
    SELECT pr.media_id, class, count(*) AS n, min(frame - CASE WHEN pr.media_id = 0 THEN 0 ELSE 8 END) AS first, max(frame - CASE WHEN pr.media_id = 0 THEN 0 ELSE 8 END) AS last,
           any_value(CASE WHEN pr.media_id = 0 THEN 0 ELSE round((pr.media_id * 155000 + 8.0 / (250.0 / 160000)) / 32000 * 1000)::BIGINT END) AS offset_ms
    FROM pr, (SELECT max(media_id) AS top FROM w)
    WHERE frame >= CASE WHEN pr.media_id = 0 THEN 0 ELSE 8 END AND frame < CASE WHEN pr.media_id = top THEN 250 ELSE 242 END GROUP BY pr.media_id, class"""
)
def w14_seam_trim(spark, d):
    p = _probs(spark, d).withColumns({"window": F.col("media_id"), "media_id": F.lit(0)})
    top = p.agg(F.max("window").alias("top"))
    w = p.select("media_id", "window").distinct().join(F.broadcast(top))  # one row
    w = w.select("media_id", "window", (F.col("window") * 155_000).alias("start"), (F.col("window") * 155_000 + 160_000).alias("end"), (F.col("top") * 155_000 + 160_000).alias("total"), F.lit(250).alias("frames"))
    out = frames.trimmed(p, w, 5_000, 32_000)
    return out.groupBy(F.col("window").alias("media_id"), "class").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.first("offset_ms").alias("offset_ms"))


# --- regions and windows -----------------------------------------------------------------------------


def _regions(spark, d):
    e = _events(spark, d)
    kind = F.when(F.col("event_type").isin("click", "view"), "start").otherwise("end")
    own = e.select(F.col("user_id").alias("media_id"), F.struct("t", "event_id").alias("ord"), kind.alias("kind"), F.col("t").alias("at_ms"))
    media = e.groupBy(F.col("user_id").alias("media_id")).agg(F.max("e").alias("duration_ms")).withColumn("active", F.col("media_id") % 2 == 0)
    return regions.from_events(own, media)


REGIONS = """
k AS (SELECT user_id AS media_id, event_id, t, e, CASE WHEN event_type IN ('click', 'view') THEN 'start' ELSE 'end' END AS kind FROM ev),
l AS (SELECT *, lag(kind) OVER w AS before, lag(t) OVER w AS began, lead(kind) OVER w AS next FROM k WINDOW w AS (PARTITION BY media_id ORDER BY t, event_id)),
re AS (SELECT media_id, began AS start_ms, t AS end_ms FROM l WHERE kind = 'end' AND before = 'start'
       UNION ALL SELECT l.media_id, t, m.d FROM l JOIN (SELECT user_id, max(e) AS d FROM ev GROUP BY 1) m ON m.user_id = l.media_id WHERE kind = 'start' AND next IS NULL AND media_id % 2 = 0)"""


@query(f"WITH {EV}, {REGIONS} SELECT * FROM re")
def w1_regions_from_events(spark, d):
    return _regions(spark, d).drop("ord")


@query(f"WITH {EV}, {REGIONS} SELECT * FROM re WHERE end_ms - start_ms >= 1800000")
def p1_min_duration(spark, d):
    return regions.at_least(_regions(spark, d), 1_800_000).drop("ord")


@query(
    f"""WITH {EV}, {REGIONS}, c AS (SELECT media_id, start_ms + i * 7200000 AS s, end_ms FROM (SELECT *, unnest(range(0, ceil((end_ms - start_ms) / 7200000)::BIGINT)) AS i FROM re WHERE end_ms > start_ms))
    SELECT media_id, s AS start_ms, least(end_ms, s + 7200000) AS end_ms FROM c"""
)
def w3_cap_regions(spark, d):
    return regions.capped(_regions(spark, d), 7_200_000).select("media_id", "start_ms", "end_ms")


@query(
    f"""WITH RECURSIVE {EV}, o AS (SELECT user_id AS media_id, t AS s, e, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM ev),
    g AS (SELECT media_id, i, s AS cs, e AS ce, 0 AS chunk FROM o WHERE i = 1
          UNION ALL SELECT o.media_id, o.i, CASE WHEN o.e - cs <= 86400000 THEN cs ELSE o.s END, o.e, CASE WHEN o.e - cs <= 86400000 THEN chunk ELSE chunk + 1 END FROM g JOIN o ON o.media_id = g.media_id AND o.i = g.i + 1),
    m AS (SELECT user_id AS media_id, max(e) - 1000000 AS duration_ms FROM ev GROUP BY 1),
    p AS (SELECT g.media_id, chunk, greatest(0, any_value(cs) - 60000) AS start_ms, least(any_value(duration_ms), arg_max(ce, i) + 60000) AS end_ms FROM g JOIN m ON m.media_id = g.media_id GROUP BY g.media_id, chunk)
    SELECT media_id, (row_number() OVER (PARTITION BY media_id ORDER BY chunk) - 1)::INT AS chunk, start_ms, end_ms FROM p WHERE end_ms > start_ms"""
)
def w2_greedy_packing(spark, d):
    e = _events(spark, d)
    r = e.select(F.col("user_id").alias("media_id"), F.struct("t", "event_id").alias("ord"), F.col("t").alias("start_ms"), F.col("e").alias("end_ms"))
    media = e.groupBy(F.col("user_id").alias("media_id")).agg((F.max("e") - 1_000_000).alias("duration_ms"))
    return regions.packed(r, media, 86_400_000, 60_000)


WINDOWS = """
n AS (SELECT media_id, duration_ms, greatest(1, ceil((duration_ms - 86400000) / 82800000)::BIGINT + 1) AS n FROM me WHERE duration_ms > 0),
wi AS (SELECT media_id, i::INT AS "window", i * 82800000 AS start_ms, least(duration_ms, i * 82800000 + 86400000) AS end_ms, i = n - 1 AS last FROM (SELECT *, unnest(range(0, n)) AS i FROM n))"""


@query(f"WITH {EV}, {MEDIA}, {WINDOWS} SELECT * FROM wi")
def w11_overlapping_windows(spark, d):
    return regions.overlapping_windows(_media(spark, d), 86_400_000, 3_600_000)


@query(f'WITH {EV}, {MEDIA}, {WINDOWS} SELECT media_id, "window", start_ms + CASE WHEN "window" = 0 THEN 0.0 ELSE 1800000.0 END AS own_start, end_ms - CASE WHEN last THEN 0.0 ELSE 1800000.0 END AS own_end FROM wi')
def w13_owned_spans(spark, d):
    w = regions.overlapping_windows(_media(spark, d), 86_400_000, 3_600_000)
    return regions.owned(w, 3_600_000).select("media_id", "window", "own_start", "own_end")


@query(
    """WITH RECURSIVE o AS (SELECT o_orderkey AS media_id, o_totalprice::BIGINT AS total FROM orders WHERE o_totalprice::BIGINT > 0),
    w AS (SELECT media_id, total, 0 AS w, 0::BIGINT AS s, CASE WHEN total <= 60000 OR total - 60000 < 5000 THEN total ELSE 60000 END AS e FROM o
          UNION ALL SELECT media_id, total, w + 1, s + 59000, CASE WHEN s + 119000 >= total OR total - (s + 119000) < 5000 THEN total ELSE s + 119000 END FROM w WHERE e < total)
    SELECT media_id, w AS "window", s AS "start", e AS "end", total FROM w"""
)
def w12_sample_windows(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("media_id"), F.rint("o_totalprice").cast("long").alias("total"))
    return regions.sample_windows(o, 60_000, 1_000, 5_000)


@query(
    f"""WITH {EV}, {TURN}, q AS (SELECT *, (ord % 3)::INT AS w FROM tu), wd AS (SELECT media_id, w, w = 2 AS last, min(start_ms) AS s, max(end_ms) AS e FROM q GROUP BY media_id, w)
    SELECT q.media_id, (row_number() OVER (PARTITION BY q.media_id ORDER BY start_ms, speaker_id, q.w, q.ord) - 1)::INT AS ord, start_ms, end_ms, speaker_id FROM q JOIN wd ON wd.media_id = q.media_id AND wd.w = q.w
    WHERE (start_ms + end_ms) / 2.0 >= s + CASE WHEN q.w = 0 THEN 0 ELSE 43200000 END AND (start_ms + end_ms) / 2.0 < e - CASE WHEN last THEN 0 ELSE 43200000 END"""
)
def w16_p12_merge_windows(spark, d):
    t = _turns(spark, d).withColumn("window", (F.col("ord") % 3).cast("int"))
    w = t.groupBy("media_id", "window").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).withColumn("last", F.col("window") == 2)
    return turns.merged_windows(t, w, 86_400_000).select("media_id", "ord", "start_ms", "end_ms", "speaker_id")


@query(f"WITH {EV} SELECT event_id, t + 1500 AS start_ms, e + 1500 AS end_ms FROM ev WHERE t + e >= 2 * 1704153600000 AND t + e < 2 * 1705000000000")
def p11_w15_midpoint_shift(spark, d):
    e = _events(spark, d).select("event_id", F.col("t").alias("start_ms"), F.col("e").alias("end_ms"))
    return intervals.shifted(intervals.midpoint_in(e, F.lit(1_704_153_600_000), F.lit(1_705_000_000_000)), 1500)


# --- joins -------------------------------------------------------------------------------------------


@query(f"WITH {EV}, {TURN}, {SPAN} SELECT sp.*, (SELECT arg_min(speaker_id, tu.ord) FROM tu WHERE tu.media_id = sp.media_id AND tu.start_ms <= sp.start_ms AND sp.start_ms < tu.end_ms) AS speaker_id FROM sp")
def j1_first_containing(spark, d):
    return intervals.first_containing(_spans(spark, d).withColumn("at_ms", F.col("start_ms")), _turns(spark, d)).drop("at_ms")


BEST = """
ov AS (SELECT sp.media_id, span_id, arg_max(speaker_id, (least(sp.end_ms, tu.end_ms) - greatest(sp.start_ms, tu.start_ms), -ord)) AS speaker_id
       FROM sp JOIN tu ON tu.media_id = sp.media_id AND least(sp.end_ms, tu.end_ms) > greatest(sp.start_ms, tu.start_ms) GROUP BY sp.media_id, span_id)"""


@query(f"WITH {EV}, {TURN}, {SPAN}, {BEST} SELECT sp.*, speaker_id FROM sp LEFT JOIN ov USING (media_id, span_id)")
def j2_j13_best_overlap(spark, d):
    return intervals.best_overlap(_spans(spark, d), _turns(spark, d))


@query(
    f"""WITH {EV}, {TURN}, {SPAN}, {BEST},
    f AS (SELECT sp.media_id, span_id, arg_min(speaker_id, ord) AS heard FROM sp JOIN tu ON tu.media_id = sp.media_id AND tu.start_ms <= (sp.start_ms + sp.end_ms) / 2.0 AND (sp.start_ms + sp.end_ms) / 2.0 < tu.end_ms GROUP BY 1, 2)
    SELECT sp.*, coalesce(heard, speaker_id) AS speaker_id FROM sp LEFT JOIN f USING (media_id, span_id) LEFT JOIN ov USING (media_id, span_id)"""
)
def j3_word_speakers(spark, d):
    return intervals.word_speakers(_spans(spark, d), _turns(spark, d))


CLIPPED = f"""
hw AS (SELECT media_id, i::INT AS "window", s + i * 86400000 AS s, s + (i + 1) * 86400000 AS e FROM (SELECT media_id, min(start_ms) AS s, unnest(range(0, 5)) AS i FROM tu GROUP BY media_id)),
cl AS (SELECT tu.media_id, "window", speaker_id, ord, greatest(start_ms, s) AS start_ms, least(end_ms, e) AS end_ms FROM tu JOIN hw ON hw.media_id = tu.media_id AND least(end_ms, e) > greatest(start_ms, s))"""


def _clipped(spark, d):
    t = _turns(spark, d)
    w = t.groupBy("media_id").agg(F.min("start_ms").alias("s")).withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(4))))
    day = F.lit(86_400_000).cast("long")
    return intervals.clipped(t, w.select("media_id", "window", (F.col("s") + F.col("window") * day).alias("start_ms"), (F.col("s") + (F.col("window") + 1) * day).alias("end_ms")))


@query(f"WITH {EV}, {TURN}, {CLIPPED} SELECT * FROM cl")
def j4_p13_clipped_spans(spark, d):
    return _clipped(spark, d)


@query(f'WITH {EV}, {TURN}, {CLIPPED}, s AS (SELECT media_id, "window", speaker_id, sum(end_ms - start_ms)::BIGINT AS total_ms, min(ord) AS f FROM cl GROUP BY 1, 2, 3) SELECT media_id, "window", speaker_id, total_ms, row_number() OVER (PARTITION BY media_id, "window" ORDER BY total_ms DESC, f) AS rank FROM s')
def a9_ranked_by_overlap(spark, d):
    return turns.ranked_by_overlap(_clipped(spark, d))


@query("SELECT n_nationkey, coalesce(r_name, n_name) AS name FROM (SELECT *, n_regionkey % 5 AS k FROM nation) LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) ON r_regionkey = k")
def j6_remap(spark, d):
    n = _table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("media_id"), F.col("n_name").alias("speaker_id"))
    m = _table(spark, d, "region").where("r_regionkey <> 2").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("g"))
    mapping = n.join(m, F.col("media_id") == F.col("k")).select("media_id", "speaker_id", F.col("g").alias("global_id"))
    return turns.remapped(n, mapping).select("n_nationkey", F.col("speaker_id").alias("name"))


# --- speakers ----------------------------------------------------------------------------------------


def _words(spark, d):
    """Words of conversation turns: half a second each, from a minute per turn on."""
    c = _table(spark, d, "conversations")
    w = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), "role", F.posexplode(F.split("text", " ")).alias("w", "word"))
    return w.withColumns({"start_ms": F.col("ord") * 60_000 + F.col("w") * 500, "end_ms": F.col("ord") * 60_000 + F.col("w") * 500 + 500})


WORDS = "wo AS (SELECT media_id, ord, role, (i - 1)::INT AS w, x[i] AS word, ord * 60000 + (i - 1) * 500 AS start_ms, ord * 60000 + (i - 1) * 500 + 500 AS end_ms FROM (SELECT conv_id AS media_id, turn AS ord, role, string_split(text, ' ') AS x, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM conversations))"
SPOKEN = "sk AS (SELECT *, CASE WHEN (w // 7) % 3 = 2 THEN NULL ELSE 'spk_' || ((w // 7) % 3) END AS speaker_id FROM wo)"


@query(
    f"""WITH {WORDS}, {SPOKEN},
    t AS (SELECT *, CASE WHEN row_number() OVER v = 1 OR speaker_id IS DISTINCT FROM lag(speaker_id) OVER v THEN 1 ELSE 0 END AS n FROM sk WINDOW v AS (PARTITION BY media_id, ord ORDER BY w)),
    p AS (SELECT *, sum(n) OVER (PARTITION BY media_id, ord ORDER BY w ROWS UNBOUNDED PRECEDING) - 1 AS part FROM t),
    g AS (SELECT media_id, ord, part::BIGINT AS part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(speaker_id, w) AS s0, first(speaker_id ORDER BY w) AS speaker_id,
            array_to_string(list({_STRIP.format('word')} ORDER BY w) FILTER (WHERE {_STRIP.format('word')} <> ''), ' ') AS x FROM p GROUP BY media_id, ord, part)
    SELECT media_id, ord, part, start_ms, end_ms, speaker_id, coalesce(CASE WHEN len(regexp_extract_all(x, '\\p{{Lu}}')) >= 3 AND len(regexp_extract_all(x, '\\p{{Ll}}')) = 0 THEN lower(x) ELSE x END, '') AS text FROM g"""
)
def w7_w8_s9_speaker_changes(spark, d):
    w = _words(spark, d)
    k = F.floor(F.col("w") / 7) % 3
    return speakers.regrouped(w.withColumn("speaker_id", F.when(k != 2, F.concat(F.lit("spk_"), k))))


@query(f"WITH {EV}, {TURN}, {SPAN}, {BEST} SELECT media_id, speaker_id AS id, sum(greatest(0, end_ms - start_ms))::BIGINT AS speech_ms, count(*) AS segment_count FROM sp JOIN ov USING (media_id, span_id) GROUP BY 1, 2")
def a1_roster(spark, d):
    return speakers.roster(intervals.best_overlap(_spans(spark, d), _turns(spark, d)))


@query(
    f"""WITH {WORDS}, sg AS (SELECT conv_id AS media_id, turn AS ord, turn * 60000 AS s, turn * 60000 + 500 * len(string_split(text, ' ')) AS e, text FROM conversations),
    tn AS (SELECT media_id, ord, s - 1000 AS s, s + 20000 AS e, 'spk_' || (ord % 2) AS k FROM sg WHERE media_id % 3 <> 0),
    ov AS (SELECT sg.media_id, sg.ord, arg_max(k, (least(sg.e, tn.e) - greatest(sg.s, tn.s), -tn.ord)) AS speaker_id FROM sg JOIN tn ON tn.media_id = sg.media_id AND least(sg.e, tn.e) > greatest(sg.s, tn.s) GROUP BY 1, 2)
    SELECT sg.media_id, sg.ord, 0 AS part, s AS start_ms, e AS end_ms, text, speaker_id FROM sg LEFT JOIN ov USING (media_id, ord)"""
)
def j12_assign_speakers(spark, d):
    c = _table(spark, d, "conversations")
    s = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), (F.col("turn") * 60_000).alias("start_ms"), (F.col("turn") * 60_000 + 500 * F.size(F.split("text", " "))).alias("end_ms"), "text", F.lit(None).cast("array<struct<word:string,start_ms:bigint,end_ms:bigint>>").alias("words"))
    t = s.where(F.col("media_id") % 3 != 0).select("media_id", "ord", (F.col("start_ms") - 1000).alias("start_ms"), (F.col("start_ms") + 20_000).alias("end_ms"), F.concat(F.lit("spk_"), F.col("ord") % 2).alias("speaker_id"))
    return speakers.assigned(s, t)


@query(f"WITH {EV}, f AS (SELECT user_id % 10 AS media_id, event_type, min(event_id) AS f FROM ev GROUP BY 1, 2) SELECT media_id, event_type AS speaker_id, (row_number() OVER (PARTITION BY media_id ORDER BY f) - 1)::INT AS place FROM f")
def a11_unique_speakers(spark, d):
    e = _events(spark, d)
    return turns.unique_speakers(e.select((F.col("user_id") % 10).alias("media_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("speaker_id")))


@query(f"WITH {EV}, {TURN}, f AS (SELECT media_id, speaker_id, min(ord) AS f FROM tu GROUP BY 1, 2), n AS (SELECT media_id, speaker_id, 'spk_' || (row_number() OVER (PARTITION BY media_id ORDER BY f) - 1) AS k FROM f) SELECT tu.media_id, (row_number() OVER (PARTITION BY tu.media_id ORDER BY start_ms, ord) - 1)::INT AS ord, start_ms, end_ms, k AS speaker_id FROM tu JOIN n ON n.media_id = tu.media_id AND n.speaker_id = tu.speaker_id")
def w10_normalized_labels(spark, d):
    return turns.normalized(_turns(spark, d))


@query("SELECT o_custkey % 20 AS media_id, (coalesce(max(CASE WHEN o_orderpriority LIKE '1%' THEN o_orderkey END), -1) + 1)::INT AS next FROM orders GROUP BY 1")
def a12_next_index(spark, d):
    o = _table(spark, d, "orders")
    name = F.when(F.col("o_orderpriority").startswith("1"), F.concat(F.lit("spk_"), "o_orderkey")).otherwise(F.concat("o_orderpriority", F.lit("_x")))
    return turns.next_index(o.select((F.col("o_custkey") % 20).alias("media_id"), name.alias("speaker_id")))


@query(
    f"""WITH {EV}, {TURN}, t AS (SELECT *, greatest(0, end_ms - start_ms) AS dur FROM tu),
    b AS (SELECT *, sum(dur) OVER (PARTITION BY media_id, speaker_id) AS total, coalesce(sum(dur) OVER (PARTITION BY media_id, speaker_id ORDER BY start_ms, end_ms, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
    SELECT media_id, ord, start_ms, end_ms, speaker_id, least(dur, greatest(0, 300000000 - before))::BIGINT AS take_ms FROM b WHERE total >= 3000 AND least(dur, greatest(0, 300000000 - before)) > 0"""
)
def a13_clip_budget(spark, d):
    return turns.clip_budget(_turns(spark, d), 3000, 300_000_000)


@query(f"WITH {EV}, {TURN} SELECT media_id, speaker_id, sum(greatest(0, end_ms - start_ms))::BIGINT AS total_ms FROM tu GROUP BY 1, 2 HAVING total_ms >= 400000000")
def p14_enough_speech(spark, d):
    return turns.with_enough_speech(_turns(spark, d), 400_000_000)


@query()
def j9_j10_linked_speakers(spark, d):
    """Windows of a day; a speaker's vector is the embedding that its number names."""
    t = _turns(spark, d)
    begin = t.groupBy("media_id").agg(F.min("start_ms").alias("_s"))
    day = 86_400_000
    t = t.join(begin, "media_id").withColumns({"window": F.floor((F.col("start_ms") - F.col("_s")) / day).cast("int")})
    w = t.select("media_id", "window", (F.col("_s") + F.col("window").cast("long") * day).alias("start_ms")).distinct()
    e = _table(spark, d, "embeddings").select("vec_id", "embedding")
    v = t.select("media_id", "window", "speaker_id").distinct().withColumn("vec_id", F.regexp_extract("speaker_id", r"(\d+)", 1).cast("long"))
    v = v.join(e, "vec_id").select("media_id", "window", "speaker_id", F.explode(F.array(F.lit("local"), F.lit("prior"))).alias("side"), F.col("embedding").cast("array<double>").alias("vector"))
    return turns.linked(t.drop("_s"), w, v, 43_200_000)


@query(f"WITH {EV}, {TURN}, {SPAN}, {BEST} SELECT sp.media_id, count(DISTINCT speaker_id) AS speakers, count(speaker_id) AS tagged FROM sp LEFT JOIN ov USING (media_id, span_id) GROUP BY 1")
def a14_speaker_counts(spark, d):
    return turns.counts(intervals.best_overlap(_spans(spark, d), _turns(spark, d)))


@query("SELECT c_mktsegment AS media_id, 'spk_' || (c_custkey % 4) AS id, sum(greatest(0, floor(c_acctbal)))::BIGINT AS speech_ms, count(*) AS segment_count, any_value(r_name) AS embedding FROM customer LEFT JOIN region ON 'spk_' || r_regionkey = 'spk_' || (c_custkey % 4) AND r_regionkey <> 3 GROUP BY 1, 2")
def j8_roster_embeddings(spark, d):
    c = _table(spark, d, "customer")
    s = c.select(F.col("c_mktsegment").alias("media_id"), F.concat(F.lit("spk_"), F.col("c_custkey") % 4).alias("speaker_id"), F.lit(0).cast("long").alias("start_ms"), F.floor("c_acctbal").cast("long").alias("end_ms"))
    r = _table(spark, d, "region").where("r_regionkey <> 3").select(F.concat(F.lit("spk_"), "r_regionkey").alias("speaker_id"), F.col("r_name").alias("vector"))
    return speakers.roster(s, s.select("media_id", "speaker_id").distinct().join(r, "speaker_id"))


# --- segments and text -------------------------------------------------------------------------------


@query("SELECT l_returnflag AS media_id, coalesce(round(sum(l_discount * greatest(l_quantity::BIGINT, 1)) / sum(greatest(l_quantity::BIGINT, 1)), 3), 0) AS confidence FROM lineitem GROUP BY 1")
def a2_overall_confidence(spark, d):
    li = _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("media_id"), F.lit("speech").alias("kind"), F.lit(0).cast("long").alias("start_ms"), F.col("l_quantity").cast("long").alias("end_ms"), F.col("l_discount").alias("confidence"))
    return segments.overall_confidence(li)


@query("WITH f AS (SELECT source AS media_id, lang, min(doc_id) AS c FROM documents WHERE lang <> 'unknown' GROUP BY 1, 2) SELECT media_id, array_to_string(list(lang ORDER BY c), ',') AS languages FROM f GROUP BY 1")
def a3_languages(spark, d):
    docs = _table(spark, d, "documents").select(F.col("source").alias("media_id"), F.col("doc_id").alias("chunk"), F.col("lang").alias("language"))
    return segments.languages(docs).withColumn("languages", F.array_join("languages", ","))


@query(f"SELECT conv_id AS media_id, {_STRIP.format("array_to_string(list(text ORDER BY turn), ' ')")} AS text FROM conversations GROUP BY 1")
def a4_full_text(spark, d):
    return segments.full_text(_table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("chunk"), F.lit(0).alias("seg"), "text"))


@query(rf"SELECT doc_id, {_STRIP.format(r"regexp_replace(regexp_replace(replace(lower(text), '’', ''''), '[^\p{L}\p{N}_\x09-\x0D\x1C-\x20\x{85}\x{A0}]', ' ', 'g'), '[\x09-\x0D\x1C-\x20\x{85}\x{A0}]+', ' ', 'g')")} AS norm FROM documents")
def s1_normalize_for_matching(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.normalize_for_matching(F.col("text")).alias("norm"))


CAPS = r"(len(regexp_extract_all({0}, '\p{{Lu}}')) >= 3 AND len(regexp_extract_all(replace(replace({0}, 'ª', ''), 'º', ''), '\p{{Ll}}')) = 0)"


@query(f"SELECT doc_id, {CAPS.format('text')} AS caps FROM documents")
def s2_mostly_uppercase(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.is_mostly_uppercase(F.col("text")).alias("caps"))


@query(f"WITH s AS (SELECT doc_id, {_STRIP.format('text')} AS x FROM documents) SELECT doc_id, CASE WHEN {CAPS.format('x')} THEN lower(x) ELSE x END AS text FROM s")
def s3_normalize_segment_text(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.normalize_segment_text(F.col("text")).alias("text"))


@query("SELECT c_custkey, round(least(greatest(exp(c_acctbal / 5000 - 1), 0), 1), 3) AS confidence, CASE WHEN c_acctbal > 0 THEN ln(greatest(least(c_acctbal / 10000, 1), 1e-6)) ELSE -0.5 END AS logprob FROM customer")
def s4_s5_confidence(spark, d):
    c = _table(spark, d, "customer")
    return c.select("c_custkey", S.logprob_to_confidence(F.col("c_acctbal") / 5000 - 1).alias("confidence"), S.confidence_to_logprob(F.col("c_acctbal") / 10000).alias("logprob"))


@query(
    """WITH c AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
    SELECT vec_id, round(list_cosine_similarity(e, b), 9) AS cosine FROM c WHERE b IS NOT NULL"""
)
def s7_cosine(spark, d):
    from pyspark.sql import Window as W

    e = _table(spark, d, "embeddings").withColumn("b", F.lag("embedding").over(W.partitionBy("label").orderBy("vec_id"))).where("b is not null")
    return e.select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("b")), 9).alias("cosine"))


@query("SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: round(x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6))) AS total FROM embeddings WHERE len(embedding) = 64")
def s8_p15_unit_vectors(spark, d):
    e = _table(spark, d, "embeddings").withColumn("u", S.unit(F.col("embedding"), 64)).where("u is not null")
    return e.select("vec_id", F.aggregate("u", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("SELECT event_id, greatest(0, round_even(value * 16000, 0))::BIGINT AS samples, 'n' || event_type AS label, lower(event_type) SIMILAR TO '.*(speech|conversation|narration|monologue|babbling).*' AS speech, lower(event_type) IN ('click', 'view') AS relevant FROM events")
def s10_s11_p4_p5_scalars(spark, d):
    e = _table(spark, d, "events")
    return e.select("event_id", S.samples(F.col("value"), 16_000).alias("samples"), F.concat(F.lit("n"), "event_type").alias("label"), T.is_speech_label(F.col("event_type")).alias("speech"), T.prompt_relevant(F.col("event_type"), ("Click", " view ", "")).alias("relevant"))


@query("SELECT l.doc_id, CASE WHEN l.quality >= 0.5 THEN lang ELSE 'unknown' END AS trusted, CASE WHEN lower(lang) IN ('', 'auto') THEN NULL ELSE lang END AS forced, coalesce(CASE WHEN toxic = 1 THEN lang END, CASE WHEN quality = 1 THEN lang END, 'en') AS align FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def p6_s15_s16_languages(spark, d):
    x = _table(spark, d, "labels").join(_table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    over = F.when(F.col("toxic") == 1, F.col("lang")).otherwise(F.lit("auto"))
    langs = F.array(F.lit("unknown"), F.when(F.col("quality") == 1, F.col("lang")))
    return x.select("doc_id", T.trusted_language(F.col("lang"), F.col("quality").cast("double")).alias("trusted"), T.normalize_language(F.col("lang")).alias("forced"), T.alignment_language(F.lit(None).cast("string"), over, langs).alias("align"))


@query(
    rf"""WITH {WORDS}, sg AS (SELECT conv_id AS media_id, turn AS chunk, text, turn * 10000 AS off, turn * 60 + 1.0 AS s FROM conversations)
    SELECT media_id, chunk, off + (chunk * 60000) + 500 * (list_position(list_transform(string_split(text, ' '), lambda w: w <> ''), true) - 1) AS start_ms, round(least(greatest(exp(-0.5), 0), 1), 3) AS confidence,
           len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n_words, CASE WHEN {CAPS.format(_STRIP.format('text'))} THEN lower({_STRIP.format('text')}) ELSE {_STRIP.format('text')} END AS text
    FROM sg WHERE {_STRIP.format('text')} <> ''"""
)
def s24_p7_p8_recognised(spark, d):
    c = _table(spark, d, "conversations")
    second = F.col("turn") * 60
    word = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("word"), (second + i * 0.5).cast("double").alias("start"), (second + i * 0.5 + 0.5).cast("double").alias("end"), F.lit(0.9).alias("probability")))
    seg = F.struct(F.col("text").alias("text"), second.cast("double").alias("start"), (second + 1).cast("double").alias("end"), F.lit(None).cast("double").alias("avg_logprob"), F.lit(0.1).alias("no_speech_prob"), F.lit(None).cast("double").alias("compression_ratio"), word.alias("words"))
    raw = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("chunk"), (F.col("turn") * 10_000).alias("offset_ms"), F.lit("en").alias("language"), F.lit(0.4).alias("language_probability"), F.array(seg).alias("segments"))
    return segments.recognised(raw).select("media_id", "chunk", "start_ms", "confidence", F.size("words").alias("n_words"), "text")


@query(
    """WITH o AS (SELECT conv_id AS media_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text FROM conversations),
    f AS (SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY turn) - 1 AS i, text || '!' AS t, turn % 5 = 0 AS bad FROM o WHERE turn < 6)
    SELECT o.media_id, turn AS ord, o.role AS speaker_id, coalesce(t, text) AS text, coalesce(bad, true) AS alignment_failed FROM o LEFT JOIN f ON f.media_id = o.media_id AND f.i = o.i"""
)
def j5_apply_aligned(spark, d):
    c = _table(spark, d, "conversations")
    none = F.lit(None)
    line = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), F.lit("speech").alias("kind"), F.col("role").alias("speaker_id"), "text", (F.col("turn") * 10).alias("start_ms"), (F.col("turn") * 10 + 5).alias("end_ms"))
    found = c.where("turn < 6").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("id"), F.concat("text", F.lit("!")).alias("text"), (F.col("turn") * 10).alias("start_ms"), (F.col("turn") * 10 + 5).alias("end_ms"), none.cast("array<string>").alias("words"), F.lit(-0.5).alias("avg_logprob"), F.lit(0.0).alias("no_speech_prob"), F.lit(1.0).alias("compression_ratio"), none.cast("string").alias("language"), (F.col("turn") % 5 == 0).alias("alignment_failed"))
    return segments.apply_aligned(line, found).select("media_id", "ord", "speaker_id", "text", "alignment_failed")


@query("SELECT conv_id AS media_id, count(*) FILTER (WHERE role = 'user') AS alignment_failed_segments FROM conversations GROUP BY 1")
def a10_failed_alignments(spark, d):
    c = _table(spark, d, "conversations")
    return segments.failed_alignments(c.select(F.col("conv_id").alias("media_id"), (F.col("role") == "user").alias("alignment_failed")))


@query(
    """WITH o AS (SELECT conv_id AS media_id, turn * 2 AS id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations),
    f AS (SELECT conv_id AS media_id, turn AS id, text FROM conversations)
    SELECT f.media_id, f.id, coalesce(a.role, b.role) AS language, CASE WHEN a.media_id IS NULL AND b.media_id IS NULL THEN -0.5 ELSE -coalesce(a.turn, b.turn) / 10.0 END AS avg_logprob, f.text <> '' AS alignment_failed
    FROM f LEFT JOIN o a ON a.media_id = f.media_id AND a.id = f.id LEFT JOIN o b ON b.media_id = f.media_id AND b.p = f.id"""
)
def j7_map_aligned(spark, d):
    c = _table(spark, d, "conversations")
    one = F.lit(1.0)
    o = c.select(F.col("conv_id").alias("media_id"), (F.col("turn") * 2).alias("id"), (-F.col("turn") / 10).alias("avg_logprob"), one.alias("no_speech_prob"), one.alias("compression_ratio"), F.col("role").alias("language"), one.alias("language_probability"))
    f = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("id"), "text", F.lit(0).cast("long").alias("start_ms"), F.lit(1).cast("long").alias("end_ms"), F.array().cast("array<struct<word:string,start:double,end:double,probability:double>>").alias("words"), F.lit(False).alias("failed"))
    return segments.aligned(o, f).select("media_id", "id", "language", "avg_logprob", "alignment_failed")


@query("SELECT conv_id AS media_id, turn AS chunk, (row_number() OVER (PARTITION BY conv_id ORDER BY (turn * 7) % 5, turn) - 1)::INT AS ord FROM conversations")
def o2_stitched_segments(spark, d):
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("chunk"), F.lit(0).alias("seg"), ((F.col("turn") * 7) % 5).alias("start_ms"))
    return segments.stitched(c).drop("seg", "start_ms")


@query(
    """WITH s AS (SELECT *, turn / 10.0 AS c FROM conversations WHERE role <> 'system')
    SELECT conv_id AS media_id, turn AS ord, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS id, round(CASE WHEN c > 0 THEN ln(greatest(least(c, 1), 1e-6)) ELSE -0.5 END, 9) AS avg_logprob,
           len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n_words FROM s"""
)
def p20_typed_segments(spark, d):
    c = _table(spark, d, "conversations")
    none = F.lit(None).cast("double")
    t = c.select(F.col("conv_id").alias("media_id"), F.col("turn").alias("ord"), F.when(F.col("role") == "system", "sound").otherwise("speech").alias("kind"), (F.col("turn") / 10).alias("confidence"), none.alias("avg_logprob"), none.alias("no_speech_prob"), none.alias("compression_ratio"), F.lit(None).cast("boolean").alias("alignment_failed"), F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"))).alias("words"))
    return segments.typed(t).select("media_id", "ord", "id", F.round("avg_logprob", 9).alias("avg_logprob"), F.size("words").alias("n_words"))


# --- the timeline ------------------------------------------------------------------------------------


def _timeline(spark, d):
    e = _events(spark, d)
    speech = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("ord"), F.col("t").alias("start_ms"), F.col("e").alias("end_ms"), F.col("event_type").alias("text"), (F.col("value") / 500).alias("confidence"))
    sound = frames.merged(_sounds(spark, d), 21_600_000).withColumn("ord", F.col("class").cast("long"))
    return assemble.timeline(speech, sound)


TIMELINE = """
tl AS (SELECT media_id, 'sound' AS kind, start_ms, end_ms, label, score, NULL AS text, CASE label WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS o FROM mg
       UNION ALL SELECT user_id, 'speech', t, e, NULL, NULL, event_type, event_id FROM ev WHERE event_type IN ('click', 'view')),
tt AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY start_ms, kind = 'sound', o) - 1)::INT AS ord FROM tl)"""


@query(f"WITH {EV}, {MERGED}, {TIMELINE} SELECT media_id, ord, kind, start_ms, end_ms, text, label, score FROM tt")
def timeline(spark, d):
    """Speech and merged sound events of each media in one order (U1, O1, W6)."""
    return _timeline(spark, d).select("media_id", "ord", "kind", "start_ms", "end_ms", "text", "label", "score")


@query(f"WITH {EV}, {MERGED}, {TIMELINE} SELECT media_id, count(*) AS n, count(label) AS n_sound, max(end_ms / 1000.0) AS last FROM tt GROUP BY 1")
def s21_p17_response(spark, d):
    rows = _timeline(spark, d)
    media = _media(spark, d)
    empty = media.select("media_id")
    body = assemble.response(rows, media, segments.overall_confidence(rows), empty.withColumn("languages", F.array(F.lit("en"))), empty.withColumn("text", F.lit("x")))
    parsed = body.select("media_id", F.from_json("body", "struct<segments:array<struct<kind:string,start:double,end:double,label:string,text:string>>>").alias("b")).select("media_id", F.explode("b.segments").alias("s"))
    return parsed.groupBy("media_id").agg(F.count("*").alias("n"), F.count("s.label").alias("n_sound"), F.max("s.end").alias("last"))


@query("SELECT event_type AS label, count(*) AS n, max(value) AS top, epoch_ms(time_bucket(INTERVAL 1 DAY, ts)) AS start_ms FROM events GROUP BY 1, 4")
def t4_tumbling_counts(spark, d):
    from chronoweave.streaming.vad import hopping_counts

    e = _table(spark, d, "events").select("ts", F.col("event_type").alias("label"), "value")
    return hopping_counts(e, "1 day", "1 day").select("label", "n", "top", F.unix_millis("start").alias("start_ms"))


@query(
    f"""WITH {EV}, g AS (SELECT *, CASE WHEN t - lag(t) OVER w < 1800000 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY event_type ORDER BY t, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY event_type ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS isle FROM g)
    SELECT event_type AS label, count(*) AS n, max(value) AS top, min(t) AS start_ms FROM i GROUP BY event_type, isle"""
)
def t5_label_sessions(spark, d):
    from chronoweave.streaming.vad import label_sessions

    e = _table(spark, d, "events").select("ts", F.col("event_type").alias("label"), "value")
    return label_sessions(e, "30 minutes").select("label", "n", "top", F.unix_millis("start").alias("start_ms"))
