"""Queries over identities, frame order and audio."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export as ex
from ..operators import identity as ident
from ..operators import timeline as tl
from ..sources import views as v


def identity_topk1(spark: SparkSession, sf: str) -> DataFrame:
    return ident.nearest(v.probes(spark, sf), v.gallery(spark, sf)).select("vec_id", "identity_id", F.round("score", 6).alias("score"), "tier")


def identity_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return ident.nearest(v.probes(spark, sf), v.gallery(spark, sf), exclude=3).select("vec_id", "identity_id", F.round("score", 6).alias("score"), "tier")


def identity_tier(spark: SparkSession, sf: str) -> DataFrame:
    return ident.nearest(v.probes(spark, sf), v.gallery(spark, sf)).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


def l2_norm(spark: SparkSession, sf: str) -> DataFrame:
    e = v.probes(spark, sf).select("vec_id", ident.l2(F.col("embedding")).alias("u"))
    return e.select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x), 6).alias("len2"), F.posexplode("u").alias("i", "u")).withColumn("u", F.round("u", 6))


def cosine_to_first(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    return e.join(F.broadcast(v.gallery(spark, sf).select(F.col("identity_id").alias("label"), F.col("embedding").alias("g"))), "label").select("vec_id", F.round(ident.dot(F.col("e"), F.col("g")), 6).alias("cosine"))


def centroid_fold(spark: SparkSession, sf: str) -> DataFrame:
    c = ident.centroids(v.table(spark, sf, "embeddings"))
    return c.select("label", "n", F.posexplode("e").alias("i", "c")).withColumn("c", F.round("c", 6))


def newly_visible(spark: SparkSession, sf: str) -> DataFrame:
    return tl.newly_visible(v.track_clock(spark, sf))


def jump_detect(spark: SparkSession, sf: str) -> DataFrame:
    return tl.jumps(v.track_clock(spark, sf).selectExpr("track_id AS stream", "event_id AS seq", "frame_index"))


def track_life(spark: SparkSession, sf: str) -> DataFrame:
    return tl.lives(v.track_clock(spark, sf))


def miss_streak(spark: SparkSession, sf: str) -> DataFrame:
    """How many tracks have which longest bridged gap, by class of gap."""
    t = tl.lives(v.track_clock(spark, sf))
    k = F.when(F.col("longest_miss") == 0, "none").when(F.col("longest_miss") <= tl.MASKED_MISSES, "masked").otherwise("coasting")
    return t.groupBy(k.alias("gap")).agg(F.count("*").alias("n"), F.sum("hits").alias("hits"))


def backfill_lookahead(spark: SparkSession, sf: str) -> DataFrame:
    clock = v.track_clock(spark, sf)
    return tl.backfill(tl.newly_visible(clock), clock).select("track_id", "frame_index", "shown")


def hold_window(spark: SparkSession, sf: str) -> DataFrame:
    return tl.held(v.track_clock(spark, sf).selectExpr("track_id AS stream", "frame_index").distinct()).withColumn("released_by", F.coalesce("released_by", F.lit(-1)))


def active_tracks(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks that are masked at a frame: interval and visibility together."""
    o = v.table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_custkey % 100 AS start_frame", "CASE WHEN o_orderkey % 3 = 0 THEN -1L ELSE o_custkey % 100 + o_orderkey % 40 END AS end_frame", "o_orderkey % 2 AS kind", "o_orderkey % 7 = 0 AS lost", "o_orderkey % 5 AS miss")
    f = spark.range(0, 120, 20).withColumnRenamed("id", "frame")  # six frames
    hit = o.join(F.broadcast(f)).where(tl.active_at(F.col("start_frame"), F.col("end_frame"), F.col("frame")) & tl.visible(F.col("kind"), F.col("lost"), F.col("miss")))
    return hit.groupBy("frame").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def audio_hit_preview(spark: SparkSession, sf: str) -> DataFrame:
    return tl.audio_at(v.audio_samples(spark, sf), v.audio_ranges(spark, sf))


def audio_edit_export(spark: SparkSession, sf: str) -> DataFrame:
    return tl.audio_edit(v.audio_samples(spark, sf), v.audio_ranges(spark, sf))


def audio_plan_text(spark: SparkSession, sf: str) -> DataFrame:
    r = v.audio_ranges(spark, sf)
    return tl.edit_text(r, False).withColumn("kind", F.lit("silence")).unionByName(tl.edit_text(r, True).withColumn("kind", F.lit("beep")))


def audio_normalize(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").selectExpr("o_orderkey", "cast(o_custkey % 37 AS double)/2 - 3 AS a", "cast(o_orderkey % 41 AS double)/2 - 3 AS b")
    r = o.withColumn("r", tl.clean_range(F.col("a"), F.col("b")))
    return r.select("o_orderkey", F.round("r.start_sec", 4).alias("start_sec"), F.round("r.end_sec", 4).alias("end_sec"))


def _pcm(spark: SparkSession, sf: str) -> DataFrame:
    """Samples of two 'videos' from event values."""
    return v.table(spark, sf, "events").selectExpr("event_id % 2 AS video_id", "event_id div 2 AS sample_ix", "cast(cast(value * 97 AS bigint) % 30000 - 15000 AS int) AS value")


def peak_envelope(spark: SparkSession, sf: str) -> DataFrame:
    return tl.peaks(_pcm(spark, sf), None, 300).select("video_id", "bucket", F.round("peak", 6).alias("peak"))


def peak_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return tl.soft_normalise(tl.peaks(_pcm(spark, sf), None, 300)).select("video_id", "bucket", F.round("peak", 6).alias("peak"))


def peak_sample(spark: SparkSession, sf: str) -> DataFrame:
    p = tl.peaks(_pcm(spark, sf), None, 240)
    arr = p.groupBy("video_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "peak"))), lambda x: x["peak"]).alias("p"))
    t = spark.range(0, 11)
    return arr.join(F.broadcast(t)).select("video_id", F.col("id").alias("tenth"), F.round(tl.peak_between(F.col("p"), F.col("id") / 10.0), 6).alias("peak"))


_NEAREST = lambda more: f"""WITH {v.PROBES_SQL}, gn AS (SELECT identity_id, list_transform(g, lambda x: x / sqrt(greatest(list_sum(list_transform(g, lambda u: u*u)), 1e-12))) AS g FROM gallery {more}),
 s AS (SELECT vec_id, identity_id, list_sum(list_transform(list_zip(e, g), lambda p: p[1]*p[2])) AS sc FROM probe, gn),
 b AS (SELECT vec_id, greatest(max(sc), 0) AS score, CASE WHEN max(sc) > 0 THEN arg_max(identity_id, sc) ELSE -1 END AS id FROM s GROUP BY vec_id),
 t AS (SELECT *, CASE WHEN id < 0 THEN 0 WHEN score >= 0.62 THEN 2 WHEN score >= 0.48 THEN 3 ELSE 0 END AS tier FROM b)"""  # noqa: E731
_FR = f"WITH {v.TRACK_CLOCK_SQL}, f AS (SELECT DISTINCT track_id, frame_index FROM clock)"
_NEW = f"{_FR}, l AS (SELECT *, lag(frame_index) OVER (PARTITION BY track_id ORDER BY frame_index) AS b FROM f), n AS (SELECT track_id, frame_index FROM l WHERE b IS NULL OR b < frame_index-1)"
_LIFE = f"""{_FR}, m AS (SELECT *, coalesce(frame_index - lag(frame_index) OVER (PARTITION BY track_id ORDER BY frame_index) - 1, 0) AS miss FROM f),
 k AS (SELECT *, sum((miss > 90)::INT) OVER (PARTITION BY track_id ORDER BY frame_index)::BIGINT AS life FROM m),
 t AS (SELECT track_id, life, min(frame_index) AS first_frame, max(frame_index) AS last_frame, count(*) AS hits, max(CASE WHEN miss <= 90 THEN miss ELSE 0 END) AS longest_miss FROM k GROUP BY ALL)"""
_PEAKS = lambda n: f"""s AS (SELECT event_id%2 AS video_id, event_id//2 AS ix, (trunc(value*97)::BIGINT % 30000 - 15000)::INT AS val FROM events),
 z AS (SELECT video_id, (max(ix)+{n})//{n} AS per FROM s GROUP BY ALL),
 b AS (SELECT video_id, per, (ix//per)::INT AS bucket, max(abs(val/32768.0::DOUBLE)) AS peak, count(*) AS n FROM s JOIN z USING (video_id) GROUP BY ALL), r AS (SELECT * FROM b WHERE n=per OR peak>0),
 l AS (SELECT video_id, max(bucket) AS last, arg_max(peak, bucket) AS tail FROM r GROUP BY ALL), e AS (SELECT video_id, last, tail, unnest(generate_series(0,{n - 1}))::INT AS bucket FROM l),
 p AS (SELECT e.video_id, e.bucket, CASE WHEN e.bucket > last THEN tail*0.15 ELSE coalesce(r.peak,0) END AS peak FROM e LEFT JOIN r ON e.video_id=r.video_id AND e.bucket=r.bucket)"""  # noqa: E731

RATE = 177  # samples a second of the rendered audio: no whole number of a tone's periods


def audio_rendered(spark: SparkSession, sf: str) -> DataFrame:
    """All samples of all videos as written, after mutes and beeps."""
    samples = v.table(spark, sf, "events").selectExpr("user_id % 50 AS video_id", "event_id AS sample_ix", "cast(cast(value * 97 AS bigint) % 30000 - 15000 AS int) AS value")
    return tl.render_audio(samples, v.audio_ranges(spark, sf), RATE)


def _sightings(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "lineitem").selectExpr("(l_orderkey div 4) % 4 AS video_id", "l_orderkey div 16 AS frame_index", "l_suppkey % 40 AS id", "cast(l_partkey * 37 % 560 AS int) AS x", "cast(l_suppkey * 53 % 400 AS int) AS y", "cast(l_quantity AS int) + 8 AS w", "cast(l_linenumber AS int) * 6 + 8 AS h", "l_linenumber % 3 AS kind")


def export_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What is masked on each frame, in order: tracks, manual and static boxes, and what appears on the next four frames."""
    s = _sightings(spark, sf)
    frames = s.select("video_id", "frame_index").distinct()
    one = s.groupBy("video_id", "frame_index", "id").agg(F.min(F.struct("x", "y", "w", "h", "kind")).alias("b")).select("video_id", "frame_index", "id", "b.*")
    tracks = one.where("kind > 0")
    manual = v.table(spark, sf, "orders").where("o_orderkey % 3 = 0").selectExpr("(o_orderkey div 4) % 4 AS video_id", "o_orderkey AS id", "true AS enabled", "o_custkey * 5 AS start", "o_orderkey div 16 AS frame_index", "cast(o_custkey % 500 AS int) AS x", "30 AS y", "20 AS w", "20 AS h")
    static = v.table(spark, sf, "customer").selectExpr("c_custkey % 4 AS video_id", "c_custkey AS id", "c_custkey % 5 > 0 AS enabled", "c_custkey * 7 AS start", "CASE WHEN c_custkey IN (97, 194, 291, 388) THEN -1 ELSE c_custkey * 7 + c_custkey % 30 END AS end", "5 AS x", "cast(c_custkey % 300 AS int) AS y", "12 AS w", "12 AS h")
    boxes = ex.to_redact(frames, tracks.withColumn("enabled", F.col("kind") == 1), manual, static)
    new = ex.appeared(tracks).select("video_id", "frame_index", F.lit(ex.AUTO).alias("ord"), "id", "x", "y", "w", "h")
    done = ex.frame_rects(frames, boxes, new)
    return done.select("video_id", "frame_index", F.size("rects").alias("n"), "n_late", ex.rects_text(F.col("rects")).alias("rects"))


QUERIES = {
    f.__name__: f
    for f in (
        identity_topk1, identity_excluded, identity_tier, l2_norm, cosine_to_first, centroid_fold, newly_visible, jump_detect, track_life, miss_streak, backfill_lookahead, hold_window, active_tracks,
        audio_hit_preview, audio_edit_export, audio_plan_text, audio_normalize, peak_envelope, peak_normalize, peak_sample, audio_rendered, export_plan,
    )
}
_AUDIO = lambda cond, beep: f"""WITH {v.AUDIO_SQL}, h AS (SELECT sample_id, count(*) AS n, {beep} AS beep FROM samples s JOIN ranges r USING (video_id) WHERE {cond} AND end_sec > start_sec AND start_sec >= 0 GROUP BY sample_id)
 SELECT video_id, s.sample_id, t, h.n IS NOT NULL AS silenced, coalesce(h.beep, false) AS beep, coalesce(h.n, 0) AS n_ranges FROM samples s LEFT JOIN h USING (sample_id)"""  # noqa: E731
ORACLE = {
    "identity_topk1": f"{_NEAREST('')} SELECT vec_id, CASE WHEN tier=0 THEN -1 ELSE id END::BIGINT AS identity_id, round(score,6) AS score, tier FROM t",
    "identity_excluded": f"{_NEAREST('WHERE identity_id <> 3')} SELECT vec_id, CASE WHEN tier=0 THEN -1 ELSE id END::BIGINT AS identity_id, round(score,6) AS score, tier FROM t",
    "identity_tier": f"{_NEAREST('')} SELECT tier, count(*) AS n, round(sum(score),4) AS total FROM t GROUP BY tier",
    "l2_norm": f"WITH {v.PROBES_SQL} SELECT vec_id, round(list_sum(list_transform(e, lambda u: u*u)),6) AS len2, i, round(e[i+1],6) AS u FROM (SELECT vec_id, e, unnest(range(len(e)))::INT AS i FROM probe)",
    "cosine_to_first": f"WITH {v.GALLERY_SQL} SELECT vec_id, round(list_sum(list_transform(list_zip(g, embedding), lambda p: p[1]*p[2]::DOUBLE)),6) AS cosine FROM embeddings JOIN gallery ON label=identity_id",
    "centroid_fold": """WITH RECURSIVE s AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, list_transform(embedding, lambda v: v::DOUBLE / sqrt(greatest(list_sum(list_transform(embedding, lambda u: u::DOUBLE*u::DOUBLE)), 1e-12))) AS e FROM embeddings),
 c AS (SELECT label, k, e FROM s WHERE k=1 UNION ALL SELECT label, k, list_transform(m, lambda v: v / sqrt(greatest(list_sum(list_transform(m, lambda u: u*u)), 1e-12))) AS e FROM
  (SELECT s.label, s.k, list_transform(list_zip(c.e, s.e), lambda p: (p[1]*c.k + p[2])/(c.k+1)) AS m FROM c JOIN s ON s.label=c.label AND s.k=c.k+1))
 SELECT label, n, i, round(e[i+1],6) AS c FROM (SELECT label, n, e, unnest(range(len(e)))::INT AS i FROM (SELECT label, max(k)::INT AS n, arg_max(e, k) AS e FROM c GROUP BY label))""",
    "newly_visible": f"{_NEW} SELECT * FROM n",
    "jump_detect": f"WITH {v.TRACK_CLOCK_SQL}, l AS (SELECT *, lag(frame_index) OVER (PARTITION BY track_id ORDER BY event_id) AS b FROM clock) SELECT track_id AS stream, event_id AS seq, frame_index, coalesce(frame_index > b+1 OR frame_index < b, false) AS jump FROM l",
    "track_life": f"{_LIFE} SELECT * FROM t",
    "miss_streak": f"{_LIFE} SELECT CASE WHEN longest_miss=0 THEN 'none' WHEN longest_miss<=2 THEN 'masked' ELSE 'coasting' END AS gap, count(*) AS n, sum(hits)::BIGINT AS hits FROM t GROUP BY ALL",
    "backfill_lookahead": f"{_NEW}, a AS (SELECT DISTINCT frame_index AS shown FROM clock) SELECT track_id, frame_index, shown FROM n JOIN a ON shown BETWEEN frame_index-4 AND frame_index-1",
    "hold_window": f"{_FR} SELECT track_id AS stream, frame_index, coalesce(lead(frame_index, 4) OVER (PARTITION BY track_id ORDER BY frame_index), -1) AS released_by FROM f",
    "active_tracks": "WITH o AS (SELECT o_orderkey AS id, o_custkey%100 AS s, CASE WHEN o_orderkey%3=0 THEN -1 ELSE o_custkey%100+o_orderkey%40 END AS e, o_orderkey%2 AS kind, o_orderkey%7=0 AS lost, o_orderkey%5 AS miss FROM orders), f AS (SELECT unnest(range(0,120,20)) AS frame) SELECT frame, count(*) AS n, sum(id)::BIGINT AS ids FROM o, f WHERE frame>=s AND (e<0 OR frame<=e) AND NOT lost AND (kind<>0 OR miss<=2) GROUP BY frame",
    "audio_hit_preview": _AUDIO("t >= start_sec AND t < end_sec", "arg_min(effect, range_id) = 1"),
    "audio_edit_export": _AUDIO("t BETWEEN start_sec AND end_sec", "max(effect) = 1"),
    "audio_plan_text": f"WITH {v.AUDIO_SQL}, x AS (SELECT *, 'between(t,' || printf('%.3f', start_sec) || ',' || printf('%.3f', end_sec) || ')' AS s FROM ranges WHERE end_sec>start_sec AND start_sec>=0) SELECT video_id, string_agg(s, '+' ORDER BY range_id) AS condition, 'silence' AS kind FROM x GROUP BY video_id UNION ALL SELECT video_id, string_agg(s, '+' ORDER BY range_id), 'beep' FROM x WHERE effect=1 GROUP BY video_id",
    "audio_normalize": "WITH o AS (SELECT o_orderkey, (o_custkey%37)::DOUBLE/2-3 AS a, (o_orderkey%41)::DOUBLE/2-3 AS b FROM orders) SELECT o_orderkey, round(greatest(0,least(a,b)),4) AS start_sec, round(greatest(greatest(a,b), greatest(0,least(a,b))+0.05::DOUBLE),4) AS end_sec FROM o",
    "peak_envelope": f"WITH {_PEAKS(300)} SELECT video_id, bucket, round(peak,6) AS peak FROM p",
    "peak_normalize": f"WITH {_PEAKS(300)}, t AS (SELECT video_id, max(peak) AS top FROM p GROUP BY ALL) SELECT video_id, bucket, round(CASE WHEN top<1e-4 THEN peak ELSE greatest(0,least(1,peak*(0.92::DOUBLE/top))) END,6) AS peak FROM p JOIN t USING (video_id)",
    "peak_sample": f"WITH {_PEAKS(240)}, a AS (SELECT video_id, list(peak ORDER BY bucket) AS v FROM p GROUP BY ALL), t AS (SELECT unnest(generate_series(0,10)) AS tenth), q AS (SELECT *, tenth/10.0::DOUBLE*239 AS pos FROM a, t) SELECT video_id, tenth, round(CASE WHEN floor(pos) >= 239 THEN v[240] ELSE v[floor(pos)::INT+1]*(1-(pos-floor(pos))) + v[floor(pos)::INT+2]*(pos-floor(pos)) END,6) AS peak FROM q",
    "audio_rendered": f"""WITH {v.AUDIO_SQL},
 e AS (SELECT user_id % 50 AS video_id, event_id AS sample_ix, (trunc(value*97)::BIGINT % 30000 - 15000)::INT AS value, event_id / {RATE}.0::DOUBLE AS t FROM events),
 h AS (SELECT video_id, sample_ix, max(effect) AS effect FROM e JOIN ranges r USING (video_id) WHERE end_sec > start_sec AND start_sec >= 0 AND t BETWEEN start_sec AND end_sec GROUP BY ALL)
 SELECT video_id, sample_ix, CASE WHEN effect = 1 THEN round(sin(sample_ix * {2 * math.pi * tl.BEEP_HZ!r}::DOUBLE / {RATE}) * {tl.BEEP_LEVEL * tl.FULL_SCALE!r}::DOUBLE)::INT WHEN effect = 0 THEN 0 ELSE value END AS value FROM e LEFT JOIN h USING (video_id, sample_ix)""",
    "export_plan": f"""WITH s AS (SELECT (l_orderkey//4)%4 AS video_id, l_orderkey//16 AS frame_index, l_suppkey%40 AS id, {{'x': (l_partkey*37%560)::INT, 'y': (l_suppkey*53%400)::INT, 'w': l_quantity::INT+8, 'h': l_linenumber::INT*6+8, 'kind': l_linenumber%3}} AS b FROM lineitem),
 f AS (SELECT DISTINCT video_id, frame_index FROM s), t AS (SELECT video_id, frame_index, id, min(b) AS b FROM s GROUP BY ALL HAVING min(b).kind > 0),
 r AS (SELECT *, lag(frame_index) OVER (PARTITION BY video_id, id ORDER BY frame_index) IS DISTINCT FROM frame_index-1 AS fresh, b.x||','||b.y||','||b.w||','||b.h AS txt FROM t),
 m AS (SELECT (o_orderkey//4)%4 AS video_id, o_orderkey//16 AS frame_index, o_orderkey AS id, (o_custkey%500)||',30,20,20' AS txt FROM orders WHERE o_orderkey%3=0 AND o_orderkey//16 >= o_custkey*5),
 c AS (SELECT c_custkey%4 AS video_id, c_custkey AS id, c_custkey*7 AS s, CASE WHEN c_custkey IN (97, 194, 291, 388) THEN -1 ELSE c_custkey*7+c_custkey%30 END AS e, '5,'||(c_custkey%300)||',12,12' AS txt FROM customer WHERE c_custkey%5>0),
 own AS (SELECT video_id, frame_index, 0 AS o, id, txt FROM r WHERE b.kind=1 UNION ALL SELECT video_id, frame_index, 1, id, txt FROM m UNION ALL SELECT video_id, frame_index, 2, id, txt FROM f JOIN c USING (video_id) WHERE frame_index >= s AND (e < 0 OR frame_index <= e)),
 lo AS (SELECT video_id, frame_index, list(txt ORDER BY o, id) AS own FROM own GROUP BY ALL), ln AS (SELECT video_id, frame_index, list(txt ORDER BY id) AS news FROM r WHERE fresh GROUP BY ALL),
 j AS (SELECT video_id, frame_index, coalesce(own, []) AS own, coalesce(flatten(list(news) OVER (PARTITION BY video_id ORDER BY frame_index RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING)), []) AS late FROM f LEFT JOIN lo USING (video_id, frame_index) LEFT JOIN ln USING (video_id, frame_index))
 SELECT video_id, frame_index, (len(own)+len(late))::INT AS n, len(late)::INT AS n_late, array_to_string(list_concat(own, late), ';') AS rects FROM j""",
}
