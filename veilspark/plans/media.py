"""Queries over files, settings, plans, timeline scalars and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as m
from ..operators import library as lib
from ..sources import views as v


def _orders(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return v.table(spark, sf, "orders").selectExpr("o_orderkey", *cols)


def _parts(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return v.table(spark, sf, "part").selectExpr("p_partkey", *cols)


FPS = "CASE p_size % 6 WHEN 0 THEN 0.4D WHEN 1 THEN 23.5D WHEN 2 THEN 24.5D WHEN 3 THEN 29.97D WHEN 4 THEN 100.0D ELSE 60.0D END"


def timecode(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf, "p_partkey * 977 - 500 AS frame", f"{FPS} AS fps")
    micros = F.round(m.pts(F.col("frame"), F.col("fps")) * 1e6)  # whole ones, as in the SQL: rounding to 6 places goes by the quotient's shortest decimal, so near a tie the last digit differed
    return p.select("p_partkey", "frame", "fps", m.timecode(F.col("frame"), F.col("fps")).alias("code"), (micros / 1e6).alias("pts"))


def range_label(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf, "cast(o_custkey * 37 % 9000 AS double)/8 AS a", "cast(o_custkey * 37 % 9000 AS double)/8 + cast(o_orderkey % 800 AS double)/16 AS b", "o_orderkey % 2 AS e")
    return o.select("o_orderkey", m.range_label(F.col("a"), F.col("b"), F.col("e")).alias("label"))


def encode_numbers(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf, "cast(320 + p_size*31 AS int) AS w", "cast(240 + (p_partkey*17) % 700 AS int) AS h", f"{FPS} AS fps", "cast(p_partkey % 9000 AS double) AS src", "p_partkey % 500 AS done", "p_partkey % 7 * 100 AS total")
    return p.select("p_partkey", m.bitrate(F.col("w"), F.col("h"), F.col("fps"), F.col("src")).alias("kbps"), m.hold_frames(F.col("fps")).alias("hold"), m.progress(F.col("done"), F.col("total")).alias("progress"), m.even(F.col("w")).alias("even_w"))


def length_limit(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf, "p_partkey * 13 % 40000 AS frames", f"{FPS} AS fps", "p_size % 4 * 5 AS most")
    return p.select("p_partkey", m.too_long(F.col("frames"), F.col("fps"), F.col("most")).alias("too_long"))


def _zoomed(spark: SparkSession, sf: str) -> DataFrame:
    p = _parts(spark, sf, "p_partkey * 29 % 50000 AS frames", "cast(400 + p_size*20 AS double) AS width", "cast(p_partkey % 11 AS double)/10 AS zoom", "30.0D AS fps")
    return p.withColumn("ppf", m.pixels_per_frame(F.col("width"), F.col("frames"), F.col("zoom"), 24.0))


def zoom_scale(spark: SparkSession, sf: str) -> DataFrame:
    p = _zoomed(spark, sf)
    return p.select("p_partkey", F.round("ppf", 6).alias("ppf"), F.round(m.zoom_of(F.col("ppf"), F.col("width"), F.col("frames"), 24.0), 4).alias("zoom"), m.frame_at(F.lit(100.5), F.lit(3.25), F.col("ppf"), F.col("frames")).cast("long").alias("at"))


def scroll_reveal(spark: SparkSession, sf: str) -> DataFrame:
    p = _zoomed(spark, sf).where("frames > 1")
    return p.select("p_partkey", F.round(m.scroll_limit(F.lit(1000.0), F.col("width"), F.col("frames"), F.col("ppf")), 4).alias("limited"), F.round(m.reveal(F.col("frames") / 2, F.lit(10.0), F.col("width"), F.col("frames"), F.col("ppf")), 4).alias("revealed"))


def zoom_label(spark: SparkSession, sf: str) -> DataFrame:
    p = _zoomed(spark, sf).where("frames > 0")
    return p.select("p_partkey", m.zoom_label(F.col("zoom"), F.round("ppf", 6), F.col("width"), F.col("fps")).alias("label"))


def timeline_step(spark: SparkSession, sf: str) -> DataFrame:
    return _zoomed(spark, sf).select("p_partkey", F.round(m.ruler_step(F.col("ppf"), F.col("fps")), 4).alias("step"))


def thumb_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Where thumbnails stand: every so many frames in short videos, 18 stretches in long ones."""
    p = _parts(spark, sf, "p_partkey * 3 % 1500 + 1 AS frames")
    span = m.coarse_span(F.col("frames"))
    short = p.where("frames <= 600").select("p_partkey", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1, span)).alias("frame"), span.alias("span"))
    long = p.where("frames > 600").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(17)))).selectExpr("p_partkey", "i * frames div 18 AS frame", "greatest(1, (i+1) * frames div 18 - i * frames div 18) AS span")
    return short.unionByName(long)


def detail_windows(spark: SparkSession, sf: str) -> DataFrame:
    p = _zoomed(spark, sf).where("frames > 1").withColumn("d", m.detail_window(F.lit(20.0), F.col("width"), F.col("ppf"), F.col("frames"), m.coarse_span(F.col("frames"))))
    return p.where("d IS NOT NULL").select("p_partkey", "d.start", "d.end", "d.span")


def audio_drag(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf, "CASE o_orderkey % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'move' WHEN 2 THEN 'start' ELSE 'end' END AS op", "cast(o_custkey % 101 AS double)/8 AS x", "cast(o_orderkey % 53 AS double)/8 AS anchor", "cast(o_custkey % 7 AS double) AS a", "cast(o_custkey % 7 AS double) + 2 AS b")
    o = o.withColumn("r", m.drag(F.col("op"), F.col("x"), F.col("anchor"), F.col("a"), F.col("b"), F.lit(10.0))).withColumn("c", m.committed(F.col("r.lo"), F.col("r.hi"), F.lit(10.0)))
    return o.where("c IS NOT NULL").select("o_orderkey", "op", F.round("c.start", 4).alias("start"), F.round("c.end", 4).alias("end"))


def handle_hits(spark: SparkSession, sf: str) -> DataFrame:
    r = v.audio_ranges(spark, sf).selectExpr("video_id AS track", "range_id", "range_id AS ord", "start_sec * 2 AS x0", "end_sec * 2 AS x1")
    p = v.audio_samples(spark, sf).selectExpr("video_id AS track", "sample_id AS point_id", "t * 2 + 1 AS x")
    return lib.handle_hit(p, r)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "pages").selectExpr("page_id AS ord", "concat(CASE WHEN page_id % 3 = 0 THEN upper(substr(url, 9, 9)) ELSE substr(url, 9, 9) END, '/', CASE page_id % 5 WHEN 0 THEN 'Clip.MP4' WHEN 1 THEN 'clip.mp4' WHEN 2 THEN 'a.b.mkv' WHEN 3 THEN 'notes.txt' ELSE 'none' END) AS path")


def ext_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    return f.where(m.is_video(F.col("path"))).select("ord", m.file_name(F.col("path")).alias("name"), m.stem(F.col("path")).alias("stem"), m.extension(F.col("path")).alias("ext"))


def file_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lib.first_per_path(_files(spark, sf))


def unique_name(spark: SparkSession, sf: str) -> DataFrame:
    taken = spark.sql("SELECT * FROM VALUES ('Clip_redacted.mp4'), ('clip_redacted_2.mp4'), ('a.b_redacted.mp4') AS t(name)")
    return lib.free_names(_files(spark, sf).select("path").distinct(), taken)


STATUS = "CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Waiting' ELSE 'Failed' END"


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return lib.status_counts(_orders(spark, sf, f"{STATUS} AS status"))


def runnable_files(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf, f"{STATUS} AS status").where(F.col("status").isin(*m.RUNNABLE))


def batch_run(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf, "o_custkey AS batch", "o_orderkey AS ord", "CASE o_orderkey % 9 WHEN 0 THEN 'cancel' WHEN 1 THEN 'fail' ELSE 'ok' END AS outcome", "o_orderkey % 14 AS minutes", "CASE WHEN o_custkey % 2 = 0 THEN 10 ELSE 0 END AS max_minutes")
    return lib.batch_run(o).select("batch", "ord", "status")


def locale_normalize(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.col("lang"), F.when(F.col("doc_id") % 4 == 0, "_XX").when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, " ").otherwise("-hant"))
    d = v.table(spark, sf, "documents").select("doc_id", raw.alias("raw")).unionByName(spark.sql("SELECT * FROM VALUES (-1L, 'zh_Hant'), (-2L, 'pt'), (-3L, ' '), (-4L, 'ZH-cn'), (-5L, 'zh_HK'), (-6L, 'xx') AS t(doc_id, raw)"))
    return d.select("doc_id", F.coalesce(m.locale(F.col("raw")), F.lit("?")).alias("code"))


def locale_lookup(spark: SparkSession, sf: str) -> DataFrame:
    texts = spark.sql("SELECT * FROM VALUES ('en','open','Open'), ('de','open','Öffnen'), ('en','close','Close') AS t(code, key, text)")
    keys = v.table(spark, sf, "documents").selectExpr("lang AS code", "CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'close' ELSE 'other' END AS key")
    return lib.localised(keys, texts).groupBy("code", "key", "text").agg(F.count("*").alias("n"))


def json_settings(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").select("event_id", F.concat(F.lit('{"scoreThreshold":'), F.when(F.col("event_id") % 3 == 0, F.lit('"x"')).otherwise((F.col("event_id") % 10 / 10.0).cast("string")), F.when(F.col("event_id") % 2 == 0, F.lit(',"redactionMode":"blur"')).otherwise(""), F.lit("}")).alias("j"))
    return e.select("event_id", m.setting(F.col("j"), "redactionMode", "mosaic").alias("mode"), m.mode(m.setting(F.col("j"), "redactionMode", "mosaic")).alias("mode_no"), m.setting_number(F.col("j"), "scoreThreshold", 0.5).alias("threshold"))


def url_form_parse(spark: SparkSession, sf: str) -> DataFrame:
    p = v.table(spark, sf, "pages").selectExpr("page_id", "concat('a=', page_id, '&b=x+y%21&a=', page_id + 1, '&c') AS q")
    f = p.withColumn("f", m.form_fields(F.col("q")))
    return f.select("page_id", F.element_at("f", "a").alias("a"), F.element_at("f", "b").alias("b"), F.element_at("f", "c").alias("c"), F.size("f").alias("n"))


def plan_resolve(spark: SparkSession, sf: str) -> DataFrame:
    c = v.table(spark, sf, "customer").selectExpr("c_custkey", "CASE c_custkey % 6 WHEN 0 THEN ' Annual' WHEN 1 THEN 'pro_x' WHEN 2 THEN 'basic_month' ELSE '' END AS id", "CASE c_custkey % 5 WHEN 0 THEN 'Pro' WHEN 1 THEN 'basic' ELSE NULL END AS tier", "cast(c_custkey % 3 AS int) AS seats", "c_custkey % 7 > 2 AS known")
    p = c.withColumn("p", m.plan(F.col("id"), F.col("tier"), F.col("seats"), F.col("known")))
    return p.select("c_custkey", "p.plan", "p.batch", "p.minutes", "p.watermark", "p.seats")


def stored_plan(spark: SparkSession, sf: str) -> DataFrame:
    """A stored licence: unknown or of another machine is none, expired is free, else its plan."""
    c = v.table(spark, sf, "customer").selectExpr("c_custkey", "c_custkey % 4 <> 0 AS known", "concat('hw', c_custkey % 3) AS hwid", "timestamp'2024-03-01 00:00:00' + make_dt_interval(cast(c_custkey % 60 AS int)) AS until")
    gone = m.expired(F.col("until"), F.lit("2024-04-01 00:00:00").cast("timestamp"))
    return c.select("c_custkey", F.when(~F.col("known") | (F.col("hwid") != "hw1"), "none").when(gone, "free").otherwise("pro_month").alias("plan"))


def text_helpers(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "documents")
    note = F.concat(F.lit("top\n=== en ===\nenglish\n=== de ===\n"), F.col("lang"), F.lit("\n=== x ===\nrest"))
    return d.select("doc_id", F.sha2(m.tail(F.col("text")), 256).alias("tail"), m.notice_section(note, F.col("lang")).alias("notice"), F.sha2(m.quoted(F.col("text")), 256).alias("arg"), m.uuid_text(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 1, 32)).alias("uuid"))


def track_labels(spark: SparkSession, sf: str) -> DataFrame:
    o = _orders(spark, sf, "o_orderkey % 2 AS kind", "o_orderkey % 4 AS tier", "o_custkey % 5 - 1 AS ident", "o_orderkey % 3 = 0 AS reverse", "o_custkey % 3 AS choice")
    o = o.withColumn("f", m.detect_flags(F.col("reverse"), F.col("choice"), F.col("ident") > 1))
    return o.select("o_orderkey", m.track_label(F.col("kind"), F.col("tier"), F.col("ident"), F.col("o_orderkey")).alias("label"), "f.faces", "f.objects", m.in_keep_list(F.col("tier"), F.col("reverse")).alias("in_keep_list"))


def track_upsert_diff(spark: SparkSession, sf: str) -> DataFrame:
    old = v.table(spark, sf, "customer").selectExpr("c_custkey AS key", "c_custkey % 3 AS val")
    new = _orders(spark, sf, "o_custkey").groupBy(F.col("o_custkey").alias("key")).agg((F.max("o_orderkey") % 3).alias("val")).where("key % 5 <> 0").unionByName(spark.range(-5, 0).selectExpr("id AS key", "1L AS val"))
    return lib.upsert_diff(old, new).select("key", "action")


def stage_bottleneck(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").selectExpr("timestamp_seconds(event_id % 3000) AS ts", "element_at(array('decode','objects','faces','track','encode'), cast(user_id % 5 AS int) + 1) AS stage", "round(value, 2) AS ms")
    s = lib.stage_totals(e)
    return s.select(F.unix_timestamp("start").alias("start"), F.round("total", 2).alias("total"), F.round("faces", 2).alias("faces"), "bottleneck", "face_bound")


def queue_stats(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").selectExpr("event_id div 200 AS win", "event_id % 29 AS depth", "user_id % 6 AS crops", "least(100.0D, value) AS gpu")
    return e.groupBy("win").agg(F.max("depth").alias("max_depth"), F.count_if(F.col("depth") == 0).alias("starved"), F.sum("crops").alias("crops"), F.count("*").alias("frames"), F.round(F.max(F.greatest(F.lit(0.0), "gpu")), 4).alias("peak"))


def delta_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").selectExpr("user_id % 20 AS machine", "event_id AS seq", "event_id * 3 + user_id % 5 AS idle", "event_id * 5 AS kernel", "event_id * 2 AS user")
    return lib.utilisation(e).select("machine", "seq", F.round("percent", 4).alias("percent"))


def best_gpu(spark: SparkSession, sf: str) -> DataFrame:
    s = v.table(spark, sf, "supplier").selectExpr("s_suppkey % 40 AS machine", "s_suppkey AS ix", "element_at(array('nvidia','amd','intel','other'), cast(s_suppkey % 4 AS int)+1) AS vendor", "s_suppkey * 97 % 9000 * 1048576 AS memory", "CASE WHEN s_suppkey % 6 = 0 THEN 'Parsec Virtual' ELSE s_name END AS name")
    return lib.best_adapter(s)


def codec_choice(spark: SparkSession, sf: str) -> DataFrame:
    s = v.table(spark, sf, "supplier").selectExpr("s_suppkey % 60 AS machine", "s_suppkey AS ord", "concat('enc', s_suppkey % 9) AS codec", "s_suppkey % 3 = 0 AS listed", "s_suppkey % 2 = 0 AS probe_ok")
    return lib.codec_choice(s)


def update_throttle(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").selectExpr("user_id % 10 AS stream", "event_id AS seq", "event_id * 37 AS ms", "event_id % 50 = 0 AS forced")
    return lib.throttle(e).select("stream", "seq")


def face_marks(spark: SparkSession, sf: str) -> DataFrame:
    return lib.face_marks(v.detections(spark, sf).where("class_id = 0"))


def latest_request(spark: SparkSession, sf: str) -> DataFrame:
    return lib.latest_request(v.table(spark, sf, "events").selectExpr("user_id AS generation", "event_id AS ticket", "event_id % 17 AS span"))


def mask_sync(spark: SparkSession, sf: str) -> DataFrame:
    d = v.detections(spark, sf).where("class_id IN (0, 2)").selectExpr("frame_index AS scene", "class_id AS kind", "x", "y", "x * 1000L + y AS id").groupBy("scene", "kind", "id").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    boxes = d.where("id % 3 <> 0").selectExpr("scene", "kind", "id AS box_id", "x", "y")
    marks = d.where("id % 2 = 0 OR id % 3 = 0").selectExpr("scene", "kind", "id AS mark_id", "x", "y")
    return lib.mask_sync(boxes, marks)


_FPS = "(CASE p_size % 6 WHEN 0 THEN 0.4 WHEN 1 THEN 23.5 WHEN 2 THEN 24.5 WHEN 3 THEN 29.97 WHEN 4 THEN 100.0 ELSE 60.0 END)::DOUBLE"
_Z = """z0 AS (SELECT p_partkey, p_partkey*29%50000 AS frames, (400+p_size*20)::DOUBLE AS width, (p_partkey%11)::DOUBLE/10 AS zoom, 30.0::DOUBLE AS fps FROM part),
 z1 AS (SELECT *, greatest(1.0,width)/greatest(1,frames) AS fit FROM z0), z2 AS (SELECT *, greatest(fit,24.0) AS most FROM z1),
 z AS (SELECT *, CASE WHEN frames<=1 OR most<=fit*1.001::DOUBLE THEN fit ELSE fit*pow(most/fit, greatest(0,least(1,zoom))) END AS ppf FROM z2)"""
_FILES = "files AS (SELECT page_id AS ord, CASE WHEN page_id%3=0 THEN upper(substr(url,9,9)) ELSE substr(url,9,9) END || '/' || CASE page_id%5 WHEN 0 THEN 'Clip.MP4' WHEN 1 THEN 'clip.mp4' WHEN 2 THEN 'a.b.mkv' WHEN 3 THEN 'notes.txt' ELSE 'none' END AS path FROM pages)"
_CLK = lambda s: f"(lpad((floor({s}[1])//3600)::BIGINT::VARCHAR,2,'0') || ':' || lpad((floor({s}[1])::BIGINT//60%60)::VARCHAR,2,'0') || ':' || lpad((floor({s}[1])::BIGINT%60)::VARCHAR,2,'0') || '.' || lpad({s}[2]::BIGINT::VARCHAR,2,'0'))"
_SPLITSEC = lambda c: f"CASE WHEN round_even(({c}-floor({c}))*100,0) >= 100 THEN [floor({c})+1, 0] ELSE [floor({c}), round_even(({c}-floor({c}))*100,0)] END"
_ST = "CASE o_orderstatus WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Waiting' ELSE 'Failed' END"
_NAMES = lambda: "regexp_replace(list_extract(string_split_regex(path, '[/\\\\]'), -1), '\\.[^.]*$', '')"

QUERIES = {
    f.__name__: f
    for f in (
        timecode, range_label, encode_numbers, length_limit, zoom_scale, scroll_reveal, zoom_label, timeline_step, thumb_spans, detail_windows, audio_drag, handle_hits, ext_filter, file_dedup, unique_name, status_counts,
        runnable_files, batch_run, locale_normalize, locale_lookup, json_settings, url_form_parse, plan_resolve, stored_plan, text_helpers, track_labels, track_upsert_diff, stage_bottleneck, queue_stats, delta_utilisation,
        best_gpu, codec_choice, update_throttle, face_marks, latest_request, mask_sync,
    )
}
ORACLE = {
    "timecode": f"WITH p AS (SELECT p_partkey, p_partkey*977-500 AS frame, {_FPS} AS fps FROM part), q AS (SELECT *, CASE WHEN round_even(fps,0)<1 THEN 25 ELSE round_even(fps,0)::BIGINT END AS r, greatest(frame,0) AS f FROM p) SELECT p_partkey, frame, fps, lpad((f//r//3600)::VARCHAR,2,'0') || ':' || lpad((f//r//60%60)::VARCHAR,2,'0') || ':' || lpad((f//r%60)::VARCHAR,2,'0') || ':' || lpad((f%r)::VARCHAR, CASE WHEN r>=100 THEN 3 ELSE 2 END, '0') AS code, round(CASE WHEN fps>0.001 THEN frame/fps ELSE 0 END,6) AS pts FROM q",
    "range_label": f"WITH o AS (SELECT o_orderkey, (o_custkey*37%9000)::DOUBLE/8 AS a, (o_custkey*37%9000)::DOUBLE/8+(o_orderkey%800)::DOUBLE/16 AS b, o_orderkey%2 AS e FROM orders), s AS (SELECT *, {_SPLITSEC('a')} AS sa, {_SPLITSEC('b')} AS sb FROM o) SELECT o_orderkey, {_CLK('sa')} || ' – ' || {_CLK('sb')} || ' · ' || CASE WHEN e=1 THEN 'Beep' ELSE 'Mute' END AS label FROM s",
    "encode_numbers": f"WITH p AS (SELECT p_partkey, (320+p_size*31)::INT AS w, (240+(p_partkey*17)%700)::INT AS h, {_FPS} AS fps, (p_partkey%9000)::DOUBLE AS src, p_partkey%500 AS done, p_partkey%7*100 AS total FROM part), q AS (SELECT *, greatest(2000, round(w::DOUBLE*h*fps*0.14::DOUBLE/1000)::INT) AS own FROM p) SELECT p_partkey, CASE WHEN src>100 THEN greatest(own, round(src*1.05::DOUBLE)::INT) ELSE own END AS kbps, greatest(4, least(12, round((CASE WHEN fps<=1 THEN 25.0 ELSE fps END)*0.4::DOUBLE)::INT)) AS hold, CASE WHEN total>0 THEN 4+least(86, done*86//total) ELSE 4 END::INT AS progress, greatest(2, w-w%2) AS even_w FROM q",
    "length_limit": f"WITH p AS (SELECT p_partkey, p_partkey*13%40000 AS frames, {_FPS} AS fps, p_size%4*5 AS most FROM part) SELECT p_partkey, most>0 AND frames/fps > most*60+1 AS too_long FROM p",
    "zoom_scale": f"WITH {_Z} SELECT p_partkey, round(ppf,6) AS ppf, round(CASE WHEN most<=fit*1.001::DOUBLE THEN 0 ELSE greatest(0,least(1,ln(greatest(fit,least(most,ppf))/fit)/ln(most/fit))) END,4) AS zoom, CASE WHEN ppf<=0 OR frames<=0 THEN 0 ELSE greatest(0,least(frames-1,floor(3.25+100.5/ppf))) END::BIGINT AS at FROM z",
    "scroll_reveal": f"WITH {_Z}, y AS (SELECT *, width/ppf AS seen, (frames/2-10.0)*ppf AS x FROM z WHERE frames>1), u AS (SELECT *, CASE WHEN x<width*0.12 OR x>width*0.82 THEN frames/2-seen*0.33 ELSE 10.0 END::DOUBLE AS moved, greatest(0, frames-width/greatest(0.01,ppf)) AS lim FROM y) SELECT p_partkey, round(greatest(0,least(lim,1000.0)),4) AS limited, round(CASE WHEN seen>=frames THEN 0 ELSE greatest(0,least(lim,moved)) END,4) AS revealed FROM u",
    "zoom_label": f"WITH {_Z}, y AS (SELECT *, round(ppf,6) AS pp, width/greatest(0.01,round(ppf,6)) AS seen FROM z WHERE frames>0), u AS (SELECT *, seen/greatest(0.1,fps) AS sec FROM y) SELECT p_partkey, CASE WHEN zoom<0.001 THEN 'Whole video' WHEN pp>=14 THEN '1 frame' WHEN seen<=90 THEN greatest(1, round_even(seen,0)::BIGINT)::VARCHAR || ' frames' WHEN sec<90 THEN regexp_replace(printf('%.1f', sec), '\\.0$', '') || ' s' ELSE regexp_replace(printf('%.1f', sec/60), '\\.0$', '') || ' min' END AS label FROM u",
    "timeline_step": f"WITH {_Z}, y AS (SELECT *, 88/greatest(0.01,ppf) AS need FROM z) SELECT p_partkey, round(CASE WHEN need<=1 THEN 1 ELSE coalesce(list_extract(list_filter([2,5,10,15,30,30,60,150,300,450,900,1800,3600,9000,18000]::DOUBLE[], lambda s: s>=need), 1), need) END,4) AS step FROM y",
    "thumb_spans": "WITH p AS (SELECT p_partkey, p_partkey*3%1500+1 AS frames FROM part), s AS (SELECT p_partkey, frames, greatest(1, ceil(frames/80.0)::BIGINT) AS span FROM p WHERE frames<=600) SELECT p_partkey, unnest(generate_series(0, frames-1, span)) AS frame, span FROM s UNION ALL SELECT p_partkey, i*frames//18, greatest(1, (i+1)*frames//18-i*frames//18) FROM p, (SELECT unnest(generate_series(0,17)) AS i) WHERE frames>600",
    "detail_windows": f"WITH {_Z}, y AS (SELECT *, greatest(1, ceil(frames/80.0)::BIGINT) AS coarse, greatest(1.0,width/ppf) AS seen FROM z WHERE frames>1), u AS (SELECT *, greatest(0,floor(20.0-greatest(1.0,seen*0.35)))::BIGINT AS s, least(frames, ceil(20.0+seen+greatest(1.0,seen*0.35)))::BIGINT AS e FROM y), t AS (SELECT *, greatest(1,(e-s+55)//56) AS span FROM u) SELECT p_partkey, s AS start, e AS \"end\", span FROM t WHERE coarse*ppf>=140 AND e>s AND span<coarse",
    "audio_drag": """WITH o AS (SELECT o_orderkey, o_orderkey%4 AS k, (o_custkey%101)::DOUBLE/8 AS x, (o_orderkey%53)::DOUBLE/8 AS anchor, (o_custkey%7)::DOUBLE AS a, (o_custkey%7)::DOUBLE+2 AS b FROM orders),
 m AS (SELECT *, greatest(0,least(greatest(0,10.0-(b-a)), a+x-anchor)) AS mv FROM o),
 r AS (SELECT *, CASE k WHEN 0 THEN least(anchor,x) WHEN 1 THEN mv WHEN 2 THEN greatest(0,least(b-0.08,x)) ELSE a END::DOUBLE AS lo, CASE k WHEN 0 THEN greatest(anchor,x) WHEN 1 THEN mv+(b-a) WHEN 2 THEN b ELSE least(10.0,greatest(a+0.08,x)) END::DOUBLE AS hi FROM m),
 c AS (SELECT *, greatest(0,least(lo,hi)) AS s, least(10.0,greatest(lo,hi)) AS e FROM r) SELECT o_orderkey, CASE k WHEN 0 THEN 'create' WHEN 1 THEN 'move' WHEN 2 THEN 'start' ELSE 'end' END AS op, round(s,4) AS start, round(e,4) AS "end" FROM c WHERE abs(hi-lo)>=0.08::DOUBLE AND e-s>=0.08::DOUBLE""",
    "handle_hits": f"WITH {v.AUDIO_SQL}, h AS (SELECT sample_id AS point_id, range_id, CASE WHEN abs(t*2+1-start_sec*2)<=6 THEN -1 WHEN abs(t*2+1-end_sec*2)<=6 THEN 1 ELSE 0 END AS edge FROM samples JOIN ranges USING (video_id) WHERE t*2+1 >= start_sec*2-2 AND t*2+1 <= end_sec*2+2) SELECT point_id, range_id, edge FROM h QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY edge=0, CASE WHEN edge<>0 THEN range_id ELSE -range_id END)=1",
    "ext_filter": f"WITH {_FILES}, n AS (SELECT ord, list_extract(string_split(path, '/'), -1) AS name FROM files) SELECT ord, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, lower(regexp_extract(name, '(\\.[^.]*)$', 1)) AS ext FROM n WHERE lower(regexp_extract(name, '(\\.[^.]*)$', 1)) IN ('.mp4','.avi','.mov','.mkv','.wmv','.m4v','.webm','.mpg','.mpeg')",
    "file_dedup": f"WITH {_FILES} SELECT ord, path FROM files QUALIFY row_number() OVER (PARTITION BY lower(path) ORDER BY ord)=1",
    "unique_name": f"WITH {_FILES}, s AS (SELECT DISTINCT path, regexp_replace(list_extract(string_split(path, '/'), -1), '\\.[^.]*$', '') AS stem FROM files), t AS (SELECT path, i, stem || '_redacted' || CASE WHEN i>1 THEN '_' || i ELSE '' END || '.mp4' AS name FROM s, (SELECT unnest(generate_series(1,50)) AS i)) SELECT path, arg_min(name, i) AS name FROM t WHERE lower(name) NOT IN ('clip_redacted.mp4','clip_redacted_2.mp4','a.b_redacted.mp4') GROUP BY path",
    "status_counts": f"SELECT count(*) AS total, count(*) FILTER (s='Waiting') AS waiting, count(*) FILTER (s='Done') AS done, count(*) FILTER (s='Failed') AS failed, bool_or(s='Failed') AS any_failed FROM (SELECT {_ST} AS s FROM orders)",
    "runnable_files": f"SELECT o_orderkey, s AS status FROM (SELECT o_orderkey, {_ST} AS s FROM orders) WHERE s IN ('Waiting','Failed','Cancelled')",
    "batch_run": "WITH o AS (SELECT o_custkey AS batch, o_orderkey AS ord, CASE o_orderkey%9 WHEN 0 THEN 'cancel' WHEN 1 THEN 'fail' ELSE 'ok' END AS outcome, o_custkey%2=0 AND o_orderkey%14>10 AS lng FROM orders), c AS (SELECT *, sum((NOT lng AND outcome='cancel')::INT) OVER (PARTITION BY batch ORDER BY ord) AS n FROM o) SELECT batch, ord, CASE WHEN NOT lng AND outcome='cancel' AND n=1 THEN 'Cancelled' WHEN n>0 THEN 'Waiting' WHEN lng THEN 'Too long' WHEN outcome='ok' THEN 'Done' ELSE 'Failed' END AS status FROM c",
    "locale_normalize": """WITH d AS (SELECT doc_id, lang || CASE doc_id%4 WHEN 0 THEN '_XX' WHEN 1 THEN '' WHEN 2 THEN ' ' ELSE '-hant' END AS raw FROM documents UNION ALL SELECT * FROM (VALUES (-1,'zh_Hant'),(-2,'pt'),(-3,' '),(-4,'ZH-cn'),(-5,'zh_HK'),(-6,'xx'))), s AS (SELECT doc_id, lower(replace(trim(raw),'_','-')) AS s FROM d)
 SELECT doc_id, CASE WHEN s='' THEN '?' WHEN s IN ('en','de','fr','es','ja') THEN s WHEN s='pt-br' THEN 'pt-BR' WHEN s='zh-cn' THEN 'zh-CN' WHEN s='zh-tw' OR s LIKE 'zh-tw%' OR s LIKE 'zh-hk%' OR s LIKE 'zh-mo%' OR s LIKE '%hant%' THEN 'zh-TW' WHEN s LIKE 'zh%' THEN 'zh-CN' WHEN s LIKE 'pt%' THEN 'pt-BR' WHEN s LIKE 'ja%' THEN 'ja' WHEN s LIKE 'de%' THEN 'de' WHEN s LIKE 'fr%' THEN 'fr' WHEN s LIKE 'es%' THEN 'es' WHEN s LIKE 'en%' THEN 'en' ELSE '?' END AS code FROM s""",
    "locale_lookup": "WITH k AS (SELECT lang AS code, CASE doc_id%3 WHEN 0 THEN 'open' WHEN 1 THEN 'close' ELSE 'other' END AS key FROM documents) SELECT code, key, CASE WHEN key='open' AND code='de' THEN 'Öffnen' WHEN key='open' THEN 'Open' WHEN key='close' THEN 'Close' ELSE key END AS text, count(*) AS n FROM k GROUP BY ALL",
    "json_settings": "SELECT event_id, CASE WHEN event_id%2=0 THEN 'blur' ELSE 'mosaic' END AS mode, CASE WHEN event_id%2=0 THEN 1 ELSE 0 END AS mode_no, CASE WHEN event_id%3=0 THEN 0.5 ELSE event_id%10/10.0 END::DOUBLE AS threshold FROM events",
    "url_form_parse": "SELECT page_id, (page_id+1)::VARCHAR AS a, 'x y!' AS b, '' AS c, 3 AS n FROM pages",
    "plan_resolve": """WITH c AS (SELECT c_custkey, CASE c_custkey%6 WHEN 0 THEN 'annual' WHEN 1 THEN 'pro_x' WHEN 2 THEN 'basic_month' ELSE '' END AS id, CASE c_custkey%5 WHEN 0 THEN 'pro' WHEN 1 THEN 'basic' ELSE '' END AS tier, (c_custkey%3)::INT AS given, c_custkey%7>2 AS known FROM customer), p AS (SELECT *, id='annual' OR id LIKE 'pro%' OR tier='pro' AS pro, id LIKE 'basic%' OR tier='basic' AS basic FROM c)
 SELECT c_custkey, CASE WHEN pro AND id='annual' THEN 'annual' WHEN pro THEN 'pro_month' WHEN basic THEN 'basic_month' WHEN known THEN 'free' ELSE 'none' END AS plan, pro AS batch, CASE WHEN pro THEN 0 ELSE 10 END AS minutes, NOT pro AND NOT basic AS watermark, CASE WHEN NOT pro AND NOT basic THEN 0 WHEN given>0 THEN given WHEN pro THEN 2 ELSE 1 END AS seats FROM p""",
    "stored_plan": "SELECT c_custkey, CASE WHEN c_custkey%4=0 OR c_custkey%3<>1 THEN 'none' WHEN timestamp '2024-03-01' + to_days((c_custkey%60)::INT) < timestamp '2024-04-01' - interval 2 minute THEN 'free' ELSE 'pro_month' END AS plan FROM customer",
    "text_helpers": "SELECT doc_id, sha256(right(text,500)) AS tail, CASE WHEN lang='en' THEN 'english' WHEN lang='de' THEN 'de' ELSE 'english' END AS notice, sha256(CASE WHEN text='' OR regexp_matches(text, '[\\s\"]') THEN '\"' || replace(text, '\"', '\\\"') || '\"' ELSE text END) AS arg, substr(h,7,2)||substr(h,5,2)||substr(h,3,2)||substr(h,1,2)||'-'||substr(h,11,2)||substr(h,9,2)||'-'||substr(h,15,2)||substr(h,13,2)||'-'||substr(h,17,4)||'-'||substr(h,21,12) AS uuid FROM (SELECT *, sha256(doc_id::VARCHAR) AS h FROM documents)",
    "track_labels": "WITH o AS (SELECT o_orderkey, o_orderkey%2 AS kind, o_orderkey%4 AS tier, o_custkey%5-1 AS ident, o_orderkey%3=0 AS rev, o_custkey%3 AS choice FROM orders) SELECT o_orderkey, CASE tier WHEN 1 THEN 'Keep #' || CASE WHEN ident>0 THEN ident ELSE o_orderkey END WHEN 2 THEN 'Auto #' || CASE WHEN ident>0 THEN ident ELSE o_orderkey END WHEN 3 THEN 'Maybe keep #' || ident ELSE CASE WHEN kind=0 THEN 'Face #' ELSE 'Object #' END || o_orderkey END AS label, rev OR choice<>2 AS faces, CASE WHEN rev THEN ident>1 ELSE choice<>1 END AS objects, NOT rev OR tier BETWEEN 1 AND 3 AS in_keep_list FROM o",
    "track_upsert_diff": "WITH o AS (SELECT c_custkey AS key, c_custkey%3 AS val FROM customer), n AS (SELECT o_custkey AS key, max(o_orderkey)%3 AS val FROM orders WHERE o_custkey%5<>0 GROUP BY 1 UNION ALL SELECT unnest(range(-5,0)), 1) SELECT key, CASE WHEN o.val IS NULL THEN 'insert' WHEN n.val IS NULL THEN 'delete' WHEN o.val=n.val THEN 'keep' ELSE 'update' END AS action FROM o FULL JOIN n USING (key)",
    "stage_bottleneck": """WITH e AS (SELECT (event_id%3000)//5*5 AS start, user_id%5 AS s, round(value,2) AS ms FROM events), p AS (SELECT start, sum(CASE WHEN s=0 THEN ms ELSE 0 END) AS a, sum(CASE WHEN s=1 THEN ms ELSE 0 END) AS b, sum(CASE WHEN s=2 THEN ms ELSE 0 END) AS c, sum(CASE WHEN s=3 THEN ms ELSE 0 END) AS d, sum(CASE WHEN s=4 THEN ms ELSE 0 END) AS f FROM e GROUP BY start),
 q AS (SELECT *, a+b+c+d+f AS total, greatest(a,b,c,d,f) AS top FROM p), r AS (SELECT *, CASE top WHEN a THEN 'decode' WHEN b THEN 'objects' WHEN c THEN 'faces' WHEN d THEN 'track' ELSE 'encode' END AS bottleneck FROM q) SELECT start, round(total,2) AS total, round(c,2) AS faces, bottleneck, bottleneck='faces' OR (total>1 AND c>0.55::DOUBLE*total) AS face_bound FROM r""",
    "queue_stats": "SELECT event_id//200 AS win, max(event_id%29) AS max_depth, count(*) FILTER (event_id%29=0) AS starved, sum(user_id%6)::BIGINT AS crops, count(*) AS frames, round(max(greatest(0,least(100.0,value))),4) AS peak FROM events GROUP BY 1",
    "delta_utilisation": "WITH e AS (SELECT user_id%20 AS machine, event_id AS seq, event_id*3+user_id%5 AS idle, event_id*5 AS kernel, event_id*2 AS usr FROM events), d AS (SELECT machine, seq, kernel-lag(kernel) OVER w + usr-lag(usr) OVER w AS total, idle-lag(idle) OVER w AS di FROM e WINDOW w AS (PARTITION BY machine ORDER BY seq)) SELECT machine, seq, round(coalesce(greatest(0,least(100.0,CASE WHEN total>0 THEN (total-least(total,di))*100.0::DOUBLE/total END)),0),4) AS percent FROM d",
    "best_gpu": "WITH s AS (SELECT s_suppkey%40 AS machine, s_suppkey AS ix, s_suppkey%4 AS k, s_suppkey*97%9000 AS mb FROM supplier WHERE s_suppkey%6<>0), w AS (SELECT *, (CASE k WHEN 0 THEN 4000 WHEN 1 THEN 3000 WHEN 2 THEN 2000 ELSE 1000 END + CASE WHEN k=0 OR mb>=512 THEN 500 ELSE 0 END + least(mb,8000))::BIGINT AS worth FROM s) SELECT machine, ix, worth FROM w QUALIFY row_number() OVER (PARTITION BY machine ORDER BY worth DESC, ix)=1",
    "codec_choice": "SELECT s_suppkey%60 AS machine, coalesce(arg_min('enc' || (s_suppkey%9), s_suppkey) FILTER (s_suppkey%6=0), 'mp4v') AS codec FROM supplier GROUP BY 1",
    "update_throttle": "WITH e AS (SELECT user_id%10 AS stream, event_id AS seq, event_id%50=0 AS forced, row_number() OVER (PARTITION BY user_id%10, event_id*37//200 ORDER BY event_id) AS k FROM events) SELECT stream, seq FROM e WHERE forced OR k=1",
    "face_marks": f"WITH {v.DETECTIONS_SQL}, f AS (SELECT DISTINCT video_id, frame_index FROM det WHERE class_id=0), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_index)::INT AS size FROM f) SELECT *, size%15=0 AS publish FROM n",
    "latest_request": "SELECT user_id AS generation, arg_max(event_id%17, event_id) AS span, max(event_id) AS ticket FROM events GROUP BY 1",
    "mask_sync": f"""WITH {v.DETECTIONS_SQL}, d AS (SELECT DISTINCT frame_index AS scene, class_id AS kind, x, y, x*1000::BIGINT+y AS id FROM det WHERE class_id IN (0,2)), b AS (SELECT * FROM d WHERE id%3<>0), m AS (SELECT * FROM d WHERE id%2=0 OR id%3=0),
 bd AS (SELECT b.scene, b.kind, b.id AS box_id, b.id AS mark_id FROM b JOIN m USING (scene, kind, id)), n AS (SELECT b.scene, b.kind, b.id AS box_id, m.id AS mark_id, sqrt(pow(b.x-m.x,2)+pow(b.y-m.y,2)) AS dist FROM b JOIN m USING (scene, kind) WHERE NOT EXISTS (SELECT 1 FROM bd WHERE bd.scene=b.scene AND bd.kind=b.kind AND bd.box_id=b.id) AND NOT EXISTS (SELECT 1 FROM bd WHERE bd.scene=b.scene AND bd.kind=b.kind AND bd.mark_id=m.id))
 SELECT * FROM bd UNION ALL SELECT scene, kind, box_id, mark_id FROM (SELECT * FROM n WHERE dist < 80 QUALIFY row_number() OVER (PARTITION BY scene, kind, box_id ORDER BY dist, mark_id)=1)""",
}
