"""Scalar functions of the media side as Column expressions: timecodes, zoom, names, locales, plans, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VIDEO_EXTENSIONS = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".m4v", ".webm", ".mpg", ".mpeg")
LOCALES = ("en", "de", "fr", "es", "pt-BR", "ja", "zh-CN", "zh-TW")
RULER_FRAMES, RULER_SECONDS, RULER_PX = (2, 5, 10, 15, 30), (1, 2, 5, 10, 15, 30, 60, 120, 300, 600), 88
RUNNABLE = ("Waiting", "Failed", "Cancelled")
VIRTUAL_ADAPTERS = ("Microsoft Basic Render", "Oray", "IddDriver", "Virtual", "Remote", "Parsec", "VMware", "VirtualBox", "Hyper-V", "Citrix", "TeamViewer")
VENDOR_WEIGHTS = {"nvidia": 4000, "amd": 3000, "intel": 2000}


def _two(v: Column) -> Column:
    return F.when(v < 10, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))


def _whole(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("long")


def timecode(frame: Column, fps: Column) -> Column:
    """hh:mm:ss:ff, non-drop; the rate is fps rounded half to even, 25 if that is below 1."""
    r = F.bround(fps).cast("long")
    rate = F.when(r < 1, 25).otherwise(r)
    f = F.greatest(frame, F.lit(0)).cast("long")
    s, sub = _whole(f, rate), f % rate
    ff = F.when(rate >= 100, F.lpad(sub.cast("string"), 3, "0")).otherwise(_two(sub))
    return F.concat_ws(":", _two(_whole(s, F.lit(3600))), _two(_whole(s, F.lit(60)) % 60), _two(s % 60), ff)


def clock_text(sec: Column) -> Column:
    """hh:mm:ss.cc, hundredths rounded half to even and carried."""
    s = F.greatest(sec, F.lit(0.0))
    whole = F.floor(s).cast("long")
    cc = F.bround((s - whole) * 100).cast("long")
    whole, cc = F.when(cc >= 100, whole + 1).otherwise(whole), F.when(cc >= 100, 0).otherwise(cc)
    return F.concat(F.concat_ws(":", _two(_whole(whole, F.lit(3600))), _two(_whole(whole, F.lit(60)) % 60), _two(whole % 60)), F.lit("."), _two(cc))


def range_label(start: Column, end: Column, effect: Column) -> Column:
    return F.concat(clock_text(start), F.lit(" – "), clock_text(end), F.lit(" · "), F.when(effect == 1, "Beep").otherwise("Mute"))


def pts(frame: Column, fps: Column) -> Column:
    return F.when(fps > 0.001, frame / fps).otherwise(0.0)


def even(v: Column) -> Column:
    return F.greatest(F.lit(2), v - v % 2)


HOLD_LEAST, HOLD_MOST = 4, 12  # fixed values: how many frames wait before they are written


def hold_frames(fps: Column) -> Column:
    rate = F.when(fps <= 1, 25.0).otherwise(fps)
    return F.greatest(F.lit(HOLD_LEAST), F.least(F.lit(HOLD_MOST), F.round(rate * 0.4).cast("int")))


def bitrate(w: Column, h: Column, fps: Column, source: Column) -> Column:
    """Target kbit/s: by picture rate, and no less than the source's if that is known."""
    own = F.greatest(F.lit(2000), F.round(w.cast("double") * h * fps * 0.14 / 1000).cast("int"))
    return F.when(source > 100, F.greatest(own, F.round(source * 1.05).cast("int"))).otherwise(own)


def progress(processed: Column, total: Column) -> Column:
    return F.when(total > 0, 4 + F.least(F.lit(86), _whole(processed * 86, total))).otherwise(4).cast("int")


def too_long(frames: Column, fps: Column, max_minutes: Column) -> Column:
    return (max_minutes > 0) & (frames / fps > max_minutes * 60 + 1)


def pixels_per_frame(width: Column, frames: Column, zoom: Column, largest: float) -> Column:
    fit = F.greatest(F.lit(1.0), width) / F.greatest(F.lit(1), frames)
    most = F.greatest(fit, F.lit(largest))
    z = F.greatest(F.lit(0.0), F.least(F.lit(1.0), zoom))
    return F.when((frames <= 1) | (most <= fit * 1.001), fit).otherwise(fit * F.pow(most / fit, z))


def zoom_of(ppf: Column, width: Column, frames: Column, largest: float) -> Column:
    fit = F.greatest(F.lit(1.0), width) / F.greatest(F.lit(1), frames)
    most = F.greatest(fit, F.lit(largest))
    p = F.greatest(fit, F.least(most, ppf))
    return F.when(most <= fit * 1.001, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(p / fit) / F.log(most / fit))))


def scroll_limit(scroll: Column, width: Column, frames: Column, ppf: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0.0), frames - width / F.greatest(F.lit(0.01), ppf)), scroll))


def frame_at(x: Column, scroll: Column, ppf: Column, frames: Column) -> Column:
    return F.when((ppf <= 0) | (frames <= 0), 0).otherwise(F.greatest(F.lit(0), F.least(frames - 1, F.floor(scroll + x / ppf))))


def reveal(frame: Column, scroll: Column, width: Column, frames: Column, ppf: Column) -> Column:
    seen, x = width / ppf, (frame - scroll) * ppf
    moved = F.when((x < width * 0.12) | (x > width * 0.82), frame - seen * 0.33).otherwise(scroll)
    return F.when(seen >= frames, 0.0).otherwise(scroll_limit(moved, width, frames, ppf))


def zoom_label(zoom: Column, ppf: Column, width: Column, fps: Column) -> Column:
    seen = width / F.greatest(F.lit(0.01), ppf)
    sec = seen / F.greatest(F.lit(0.1), fps)
    short = lambda v: F.regexp_replace(F.format_string("%.1f", v), r"\.0$", "")
    frames = F.concat(F.greatest(F.lit(1), F.bround(seen).cast("long")).cast("string"), F.lit(" frames"))
    return F.when(zoom < 0.001, "Whole video").when(ppf >= 14, "1 frame").when(seen <= 90, frames).when(sec < 90, F.concat(short(sec), F.lit(" s"))).otherwise(F.concat(short(sec / 60), F.lit(" min")))


def ruler_step(ppf: Column, fps: Column) -> Column:
    """Frames between ruler marks that stand at least RULER_PX apart."""
    least = RULER_PX / F.greatest(F.lit(0.01), ppf)
    marks = F.concat(F.array(*(F.lit(float(x)) for x in RULER_FRAMES)), F.transform(F.array(*(F.lit(float(x)) for x in RULER_SECONDS)), lambda s: s * fps))
    return F.when(least <= 1, 1.0).otherwise(F.coalesce(F.get(F.filter(marks, lambda m: m >= least), F.lit(0)), least))


def coarse_span(frames: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(frames / 80.0)).cast("long")


def detail_window(scroll: Column, width: Column, ppf: Column, frames: Column, coarse: Column) -> Column:
    """start, end, span of the thumbnails to fetch; null where the coarse ones will do."""
    seen = F.greatest(F.lit(1.0), width / ppf)
    pad = F.greatest(F.lit(1.0), seen * 0.35)
    start, end = F.greatest(F.lit(0), F.floor(scroll - pad)).cast("long"), F.least(frames, F.ceil(scroll + seen + pad)).cast("long")
    span = F.greatest(F.lit(1), _whole(end - start + 55, F.lit(56)))
    return F.when((coarse > 0) & (coarse * ppf >= 140) & (end > start) & (span < coarse), F.struct(start.alias("start"), end.alias("end"), span.alias("span")))


def drag(op: Column, x: Column, anchor: Column, start: Column, end: Column, most: Column, least: float = 0.08) -> Column:
    """The draft range of a drag: create, move, start or end."""
    moved = F.greatest(F.lit(0.0), F.least(F.greatest(F.lit(0.0), most - (end - start)), start + x - anchor))
    lo = F.when(op == "create", F.least(anchor, x)).when(op == "move", moved).when(op == "start", F.greatest(F.lit(0.0), F.least(end - least, x))).otherwise(start)
    hi = F.when(op == "create", F.greatest(anchor, x)).when(op == "move", moved + (end - start)).when(op == "start", end).otherwise(F.least(most, F.greatest(start + least, x)))
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def committed(lo: Column, hi: Column, most: Column, least: float = 0.08) -> Column:
    """The range a drag leaves, within the video; null if it is too short."""
    a, b = F.greatest(F.lit(0.0), F.least(lo, hi)), F.least(most, F.greatest(lo, hi))
    return F.when((F.abs(hi - lo) >= least) & (b - a >= least), F.struct(a.alias("start"), b.alias("end")))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def is_video(path: Column) -> Column:
    return extension(path).isin(*VIDEO_EXTENSIONS)


def locale(raw: Column) -> Column:
    """The known locale code that a raw one stands for, or null."""
    s = F.replace(F.trim(raw), F.lit("_"), F.lit("-"))
    low = F.lower(s)
    out = F.lit(None).cast("string")
    for start, code in reversed((("zh", "zh-CN"), ("pt", "pt-BR"), ("ja", "ja"), ("de", "de"), ("fr", "fr"), ("es", "es"), ("en", "en"))):
        out = F.when(low.startswith(start), code).otherwise(out)
    out = F.when(low.startswith("zh-tw") | low.startswith("zh-hk") | low.startswith("zh-mo") | low.contains("hant"), "zh-TW").otherwise(out)
    for code in reversed(LOCALES):
        out = F.when(low == code.lower(), code).otherwise(out)
    return F.when(F.trim(F.coalesce(raw, F.lit(""))) != "", out)


def form_fields(text: Column) -> Column:
    """A URL-encoded form as a map; the last value of a key wins."""
    entries = F.filter(F.split(F.regexp_replace(text, r"^\?", ""), "&"), lambda p: p != "")
    decode = lambda s: F.coalesce(F.try_url_decode(F.coalesce(s, F.lit(""))), s, F.lit(""))
    pairs = F.transform(entries, lambda p: F.struct(decode(F.split(p, "=", 2)[0]).alias("k"), decode(F.get(F.split(p, "=", 2), F.lit(1))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def plan(plan_id: Column, tier: Column, seats: Column, known: Column) -> Column:
    """The plan that an id and a tier name give: id, batch, minutes, watermark, seats."""
    i, t = F.lower(F.trim(F.coalesce(plan_id, F.lit("")))), F.lower(F.trim(F.coalesce(tier, F.lit(""))))
    pro = i.isin("annual") | i.startswith("pro") | (t == "pro")
    basic = i.startswith("basic") | (t == "basic")
    one = lambda name, batch, minutes, mark, n: F.struct(name.alias("plan"), F.lit(batch).alias("batch"), F.lit(minutes).alias("minutes"), F.lit(mark).alias("watermark"), n.alias("seats"))
    given = lambda n: F.when(seats > 0, seats).otherwise(n)
    return (
        F.when(pro, one(F.when(i == "annual", "annual").otherwise("pro_month"), True, 0, False, given(2)))
        .when(basic, one(F.lit("basic_month"), False, 10, False, given(1)))
        .otherwise(one(F.when(known, "free").otherwise("none"), False, 10, True, F.lit(0)))
    )


def expired(until: Column, now: Column) -> Column:
    """Two minutes of grace; no date never expires."""
    return F.coalesce(until < now - F.expr("INTERVAL 2 MINUTES"), F.lit(False))


def setting(json: Column, key: str, default: str) -> Column:
    """A value of a flat settings text, or the default."""
    return F.coalesce(F.get_json_object(json, f"$.{key}"), F.lit(default))


def setting_number(json: Column, key: str, default: float) -> Column:
    """A number of a settings text; a text that is no number keeps the default."""
    return F.coalesce(F.get_json_object(json, f"$.{key}").try_cast("double"), F.lit(default))


def notice_section(text: Column, code: Column) -> Column:
    """The part of a text after ``=== code ===``, up to the next mark; else the English part, else all."""
    find = lambda c: F.nullif(F.trim(F.get(F.split(F.get(F.split(text, F.concat(F.lit("=== "), c, F.lit(" ===\n"))), F.lit(1)), "\n=== "), F.lit(0))), F.lit(""))
    return F.coalesce(find(code), find(F.lit("en")), text)


def tail(text: Column, n: int = 500) -> Column:
    return F.right(text, F.lit(n))


def quoted(arg: Column) -> Column:
    """A command argument: quoted if it is empty or has blanks or quotes, inner quotes escaped."""
    return F.when((arg == "") | arg.rlike(r'[\s"]'), F.concat(F.lit('"'), F.replace(arg, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(arg)


def uuid_text(hex32: Column) -> Column:
    """Sixteen bytes as hex in UUID form; the first three groups are little-endian."""
    b = lambda *at: F.concat(*(F.substring(hex32, 2 * i + 1, 2) for i in at))
    return F.concat_ws("-", b(3, 2, 1, 0), b(5, 4), b(7, 6), b(8, 9), b(10, 11, 12, 13, 14, 15))


def track_label(kind: Column, tier: Column, identity: Column, track: Column) -> Column:
    """Keep, Auto, Maybe keep or the kind's name, with a number."""
    named = lambda p, n: F.concat(F.lit(p), F.lit(" #"), n.cast("string"))
    who = F.when(identity > 0, identity).otherwise(track)
    return F.when(tier == 1, named("Keep", who)).when(tier == 2, named("Auto", who)).when(tier == 3, named("Maybe keep", identity)).when(kind == 0, named("Face", track)).otherwise(named("Object", track))


def mode(name: Column) -> Column:
    """mosaic 0, blur 1, solid 2; an unknown name is mosaic."""
    return F.when(name == "blur", 1).when(name == "solid", 2).otherwise(0)


def detect_flags(reverse: Column, index: Column, plates: Column) -> Column:
    """What is detected for a choice: 0 all, 1 faces, 2 objects; the reverse mode always has faces."""
    return F.struct((reverse | (index != 2)).alias("faces"), F.when(reverse, plates).otherwise(index != 1).alias("objects"))


def adapter_score(vendor: Column, memory: Column, name: Column) -> Column:
    """What a graphics adapter is worth; -1 for virtual ones."""
    virtual = F.exists(F.array(*map(F.lit, VIRTUAL_ADAPTERS)), lambda v: F.contains(name, v))
    weight = F.when(vendor == "nvidia", VENDOR_WEIGHTS["nvidia"]).when(vendor == "amd", VENDOR_WEIGHTS["amd"]).when(vendor == "intel", VENDOR_WEIGHTS["intel"]).otherwise(1000)
    discrete = (vendor == "nvidia") | (memory >= 512 * 1024 * 1024)
    mb = F.least(F.floor(memory / (1024 * 1024)).cast("long"), F.lit(8000))
    return F.when(virtual, -1).otherwise(weight + F.when(discrete, 500).otherwise(0) + mb).cast("long")


# The statuses that have a text.
STATUSES = ("Waiting", "Done", "Failed", "Cancelled", "Too long", "Processing")


def in_keep_list(tier: Column, reverse: Column) -> Column:
    """Whether the list of kept faces shows a track: all of them, or those of a tier in the reverse mode."""
    return ~reverse | tier.between(1, 3)


def in_mask_list(kind: Column) -> Column:
    """Whether the list of masks shows a track: manual and pinned ones."""
    return kind.isin(2, 3)


def status_key(status: Column) -> Column:
    """The key of a status's text; null for an unknown status."""
    return F.when(status.isin(*STATUSES), F.concat(F.lit("status"), F.replace(F.initcap(status), F.lit(" "), F.lit(""))))


def formatted(template: Column, args: Column) -> Column:
    """The template with ``{0}``, ``{1}`` and so on filled in and doubled braces halved; a bad template, or one that asks for more, stays as it is."""
    parts = F.regexp_extract_all(template, F.lit(r"(\{\{|\}\}|\{\d+\}|[^{}]+|[{}])"), F.lit(1))
    number = lambda p: F.regexp_extract(p, r"^\{(\d+)\}$", 1)
    fill = lambda p: F.when(p.isin("{{", "}}"), F.substring(p, 1, 1)).when(p.isin("{", "}"), F.lit(None)).when(number(p) != "", F.get(args, number(p).try_cast("int"))).otherwise(p)
    filled = F.transform(parts, fill)
    return F.when(F.exists(filled, lambda p: p.isNull()), template).otherwise(F.array_join(filled, ""))
