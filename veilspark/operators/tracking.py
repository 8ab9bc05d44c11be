"""Tracking and the keep-or-redact policy: an ordered fold over the frames of each video.

What happens in one frame is written once, as a step over a small state, and is the only place
where Python runs per row. In batch a partition holds whole videos in frame order and the state
of one video at a time (``track``); in streaming the state is kept by key (``streaming.tracks``).
A frame costs what is followed in it: lost faces are met by commands only, lost objects through one
array of boxes, for a stretch of frames at once in batch. Memory is that of one video's tracks. Lost faces stay while a command may still name
them: to the end in a stream, in batch up to the video's last command (``until``).

Ties are settled: pairs by score, then track, then detection in the order given.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from math import hypot, sqrt
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of association, coasting and identity.
HIGH, LOW, HIGH_IOU, LOW_IOU, LIFE, MASKED = 0.22, 0.12, 0.16, 0.08, 90, 2
OBJECT_IOU, SOFT_IOU, SOFT_PX, CHECK_EVERY, LEAST_SIDE = 0.22, 0.08, 120.0, 8, 32
KEEP, SUGGEST = 0.62, 0.48
NONE, ENROLLED, LINKED, SUGGESTED = 0, 1, 2, 3
FACE, OBJECT = 0, 1
AHEAD_FRAMES, AHEAD_DETS, AHEAD_PAIRS = 1000, 96, 1 << 22  # fixed values: of a stretch of frames whose overlaps are told at once

BOX = "struct<x:double,y:double,w:double,h:double,score:double,label:string,e:array<double>>"
FRAMES = f"video_id string, frame_index long, faces array<{BOX}>, objects array<{BOX}>, heads array<{BOX}>, commands array<struct<seq:long,op:string,args:string>>"
OUT = "video_id string, frame_index long, track_id int, kind int, x int, y int, w int, h int, score double, enabled boolean, miss int, tier int, identity_id int, label string, appeared boolean"


@dataclass
class Track:
    """What is known of one face or object. v: motion of centre and size per frame, then the box that the motion model holds."""

    id: int
    kind: int
    box: list[float]
    start: int
    score: float = 0.0
    enabled: bool = True
    miss: int = 0
    lost: bool = False
    v: list[float] = field(default_factory=lambda: [0.0] * 4)
    label: str = ""
    tier: int = NONE
    identity: int = -1
    forced: bool = False
    rejected: bool = False
    shown: list[int] = field(default_factory=list)
    e: list[float] | None = None

    # Not part of the state: where its box stands among the objects', when it was lost, its row in the output at hand, the frame of its video that it was born on, and which of a frame's detections it took last.
    slot = tick = part = row = born = took = -1

    def visible(self) -> bool:
        return not self.lost and (self.kind != FACE or self.miss <= MASKED)


def _round(v: float) -> int:
    return int(v + 0.5) if v >= 0 else -int(-v + 0.5)


def _whole(b: list[float]) -> list[int]:
    return [_round(b[0]), _round(b[1]), max(1, _round(b[2])), max(1, _round(b[3]))]


def _centre(b: list[float]) -> tuple[float, float]:
    return b[0] + b[2] / 2, b[1] + b[3] / 2


def _distance(a: list[float], b: list[float]) -> float:
    (ax, ay), (bx, by) = _centre(a), _centre(b)
    return hypot(ax - bx, ay - by)


def _iou(a: list[float], b: list[float]) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 1e-6 else 0.0


def _shares(boxes: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, area: np.ndarray) -> np.ndarray:
    """``_iou`` of every box (a row each) with everything shown, whose sides are 1 at least."""
    x, y, w, h = boxes.T[:, :, None]
    both = np.minimum(x2, x + w)
    both -= np.maximum(x1, x)
    down = np.minimum(y2, y + h)
    down -= np.maximum(y1, y)
    np.maximum(both, 0.0, out=both)
    both *= np.maximum(down, 0.0, out=down)
    union = area + w * h
    union -= both
    if w.min() <= 0 or h.min() <= 0:
        union[~(union > 1e-6)] = np.inf
    return np.divide(both, union, out=union)


def _affinity(t: list[float], d: list[float], least: float) -> float:
    v = _iou(t, d)
    if v >= 0.45:
        return v + 0.20
    if not (0.28 < d[2] / max(4.0, t[2]) < 4.5 and 0.28 < d[3] / max(4.0, t[3]) < 4.5):
        return 0.0
    if v >= least:
        return v + 0.15
    gate = 0.70 * max(hypot(t[2], t[3]), hypot(d[2], d[3]))
    far = _distance(t, d)
    return 0.0 if far > gate else 0.12 + 0.35 * (1 - far / max(gate, 1.0))


def _matches(tracks: list[Track], dets: list[dict], least: float) -> list[tuple[Track, int]]:
    """One-to-one matches, best first. Tracks have been moved on, so that no side is under 4."""
    if not tracks or not dets:
        return []
    boxes = [(*_centre(d["box"]), d["box"][2], d["box"][3], hypot(d["box"][2], d["box"][3])) for d in dets]
    pairs = []
    for i, t in enumerate(tracks):
        _, _, _, _, x, y, w, h = t.v
        cx, cy, most = x + w / 2, y + h / 2, 0.70 * (w + h)  # a diagonal is shorter than both sides
        for j, (dx, dy, dw, dh, other) in enumerate(boxes):
            ax, ay, far = abs(cx - dx), abs(cy - dy), 0.70 * other
            if most > far:
                far = most
            if (ax > far and ax + ax >= w + dw) or (ay > far and ay + ay >= h + dh):
                continue  # too far off, and no overlap
            s = _affinity(t.v[4:8], dets[j]["box"], least)
            if s > 1e-6:
                pairs.append((-s, i, j))
    taken, used = {}, set()
    for _, i, j in sorted(pairs):
        if i not in taken and j not in used:
            taken[i] = j
            used.add(j)
    return [(tracks[i], j) for i, j in taken.items()]


def _unit(v: list[float]) -> list[float]:
    n = sqrt(max(sum(x * x for x in v), 1e-12))
    return [x / n for x in v]


_ID = attrgetter("id")


@dataclass
class Video:
    """The state of one video. ``live`` holds the ids that the motion model follows."""

    tracks: list[Track] = field(default_factory=list)
    live: list[int] = field(default_factory=list)
    was: list[int] = field(default_factory=list)
    gallery: list[dict] = field(default_factory=list)
    next_id: int = 1
    next_identity: int = 1
    last: int | None = None
    keep: bool = False

    def __post_init__(self) -> None:
        """What is looked up by frame, all of it told from the tracks: the faces that are followed, all objects, those not lost, those switched off."""
        self.ticks, self.forget, self.known = 0, False, None
        self.faces = [t for t in self.tracks if t.kind == FACE and not t.lost]
        self.objects = [t for t in self.tracks if t.kind == OBJECT]
        self.boxes = np.zeros((6, max(64, 2 * len(self.objects))))
        self.placed = True  # not where frames are told ahead
        for i, t in enumerate(self.objects):
            t.slot, t.tick = i, 0
        self._sort_out()

    def _sort_out(self) -> None:
        """After a command: objects by what they are now."""
        self.stale = False
        self.present = [t for t in self.objects if not t.lost]
        self.off = [t for t in self.objects if not t.enabled]
        for t in self.objects:
            t.part = -1
            self._place(t)

    def _place(self, t: Track) -> None:
        """An object's box, and the overlap that it takes at least to match it."""
        if not self.placed:
            return
        x, y, w, h = t.shown
        self.boxes[:, t.slot] = x, y, x + w, y + h, w * h, OBJECT_IOU if t.lost and t.enabled else SOFT_IOU

    # -- state as text, for keyed state stores --
    def dump(self) -> str:
        for t in self.objects:
            if t.lost:
                t.miss, t.tick = t.miss + self.ticks - t.tick, self.ticks
        return json.dumps(asdict(self))

    @staticmethod
    def load(text: str) -> Video:
        d = json.loads(text)
        d["tracks"] = [Track(**t) for t in d["tracks"]]
        return Video(**d)

    def _by_id(self, i: int) -> Track | None:
        at = bisect_left(self.tracks, i, key=_ID)  # ids only grow, so tracks are in order
        return self.tracks[at] if at < len(self.tracks) and self.tracks[at].id == i else None

    def _new(self, kind: int, box: list[float], frame: int, score: float, label: str, inherit: bool) -> Track:
        near = inherit and any(not o.enabled and _distance(o.shown, box) <= SOFT_PX for o in (self.faces if kind == FACE else self.off))
        t = Track(self.next_id, kind, list(box), frame, score, enabled=not near, shown=_whole(box))
        t.v = [0.0] * 4 + list(box)
        t.label = f"{label} #{t.id}"
        self.next_id += 1
        self.tracks.append(t)
        if kind == FACE:
            self.faces.append(t)
            return t
        t.slot = len(self.objects)
        self.objects.append(t)
        self.present.append(t)
        if near:
            self.off.append(t)
        if self.placed and t.slot == self.boxes.shape[1]:
            self.boxes = np.concatenate([self.boxes, np.zeros_like(self.boxes)], axis=1)
        self._place(t)
        return t

    def _lose(self, lost: list[Track]) -> None:
        """Faces that are followed no more. They stay for commands, unless none can come."""
        for t in lost:
            t.lost, t.miss = True, LIFE + 1
            if self.forget:
                del self.tracks[bisect_left(self.tracks, t.id, key=_ID)]

    def no_more_commands(self) -> None:
        if not self.forget:
            self.forget = True
            self.tracks = [t for t in self.tracks if t.kind != FACE or not t.lost]

    # -- faces: motion model, two-stage matching, coasting --
    def _apply(self, t: Track, d: dict) -> None:
        vx, vy, vw, vh, x, y, w, h = t.v
        (ox, oy), (nx, ny) = _centre([x, y, w, h]), _centre(d["box"])
        grow = lambda v, new, old: max(-0.35 * old, min(0.35 * old, 0.55 * v + 0.45 * (new - old)))
        t.v = [0.5 * vx + 0.5 * (nx - ox), 0.5 * vy + 0.5 * (ny - oy), grow(vw, d["box"][2], w), grow(vh, d["box"][3], h), *d["box"]]
        t.score, t.miss, t.e = d["score"], 0, d["e"]

    def _faces(self, dets: list[dict], heads: list[dict], frame: int) -> None:
        live = self.faces
        for t in live:
            vx, vy, vw, vh, x, y, w, h = t.v
            cx, cy, w, h = x + w / 2 + vx, y + h / 2 + vy, w + vw, h + vh
            if not w > 4.0:
                w = 4.0
            if not h > 4.0:
                h = 4.0
            t.v = [vx, vy, vw, vh, cx - w / 2, cy - h / 2, w, h]
            t.e = None
        high, low = [d for d in dets if d["score"] >= HIGH], [d for d in dets if LOW <= d["score"] < HIGH]
        first = _matches(live, high, HIGH_IOU)
        hit = {t.id for t, _ in first}
        for t, j in first:
            self._apply(t, high[j])
        if low:
            second = _matches([t for t in live if t.id not in hit], low, LOW_IOU)
            for t, j in second:
                self._apply(t, low[j])
            hit |= {t.id for t, _ in second}
        gone = []
        for t in live:
            if t.id not in hit:
                t.miss += 1
                vx, vy, vw, vh, x, y, w, h = t.v
                t.v = [vx * 0.55, vy * 0.55, vw * 0.35, vh * 0.35, x, y, w, h]
                if t.miss > LIFE:
                    gone.append(t)
            if t.miss <= MASKED or not t.enabled:  # of others nobody asks where they are
                t.shown = self._coasting(t, heads)
        if gone:
            self._lose(gone)
            self.faces = [t for t in live if not t.lost]
        used = {j for _, j in first}
        for j, d in enumerate(high):
            if j not in used:
                t = self._new(FACE, d["box"], frame, d["score"], "Face", not self.keep)
                t.e = d["e"]
        self.live = [t.id for t in self.faces]

    def _coasting(self, t: Track, heads: list[dict]) -> list[int]:
        box = _whole(t.v[4:8])
        if t.miss == 0 or not heads:
            return box
        near = min(((d, i) for i, h in enumerate(heads) if (d := _distance(box, h["box"])) <= 0.85 * max(box[2], h["box"][2]) + 28), default=None)
        if near is None:
            dx, dy, pad = _round(t.v[0] * t.miss), _round(t.v[1] * t.miss), max(3, min(box[2:]) // 8)
            return [box[0] + dx - pad, box[1] + dy - pad, box[2] + 2 * pad, box[3] + 2 * pad]
        head = [int(x) for x in heads[near[1]]["box"]]
        if box[2] > 8 and box[3] > 8 and box[2] * box[3] < 2 * head[2] * head[3]:
            return [head[0] + head[2] // 2 - box[2] // 2, head[1] + head[3] // 2 - box[3] // 2, box[2], box[3]]
        return head

    # -- objects: live ones choose first, then kept lost ones, then the others --
    def _objects(self, dets: list[dict], frame: int, overlapped: dict[int, list[tuple[int, float]]] | None = None) -> list[Track]:
        """The objects that a detection has met or made on this frame. ``overlapped``: what ``_overlapped`` gives, where it is known."""
        self.ticks += 1
        met, back, free = [], [], list(range(len(dets)))
        if overlapped is None:
            overlapped = self._overlapped(dets)
        rank = lambda t: (0 if not t.lost else 2 if t.enabled else 1, t.id)
        for t in sorted((self.objects[i] for i in overlapped), key=rank):
            j = self._chosen(t, [(j, v) for j, v in overlapped[t.slot] if j in free], dets)
            if j is not None:
                d = dets[j]
                free.remove(j)
                back += [t] if t.lost else []
                t.shown, t.lost, t.miss, t.part, t.took = _whole(d["box"]), False, -1, -1, j
                t.label = f"{d['label'] or 'Object'} #{t.id}"
                met.append(t)
                self._place(t)
                if not free:
                    break
        gone = False
        for t in self.present:
            t.miss += 1
            if t.miss > LIFE:
                t.lost, t.tick, gone = True, self.ticks, True
                self._place(t)
        if gone:
            self.present = [t for t in self.present if not t.lost]
        for t in back:
            t.miss = 0
            insort(self.present, t, key=_ID)
        for j in free:
            t = self._new(OBJECT, dets[j]["box"], frame, dets[j]["score"], dets[j]["label"] or "Object", True)
            t.took = j
            met.append(t)
        return met

    def objects_ahead(self, frames: list[tuple[int, list[dict]]]) -> Iterator[list[Track]]:
        """What ``_objects`` gives on each of these frames. Until their end an object shows its box of now or one of their detections, so all overlaps are told at once."""
        n, dets = len(self.objects), [d["box"] for _, found in frames for d in found]
        holder, at = self.objects + [None] * len(dets), list(range(n))  # by box, who shows it; by slot, the box
        if dets:
            boxes = np.array(dets)
            whole = np.copysign(np.floor(np.abs(boxes) + 0.5), boxes)  # as _whole
            np.maximum(whole[:, 2:], 1, out=whole[:, 2:])
            x, y, w, h = np.concatenate([np.array([t.shown for t in self.objects], dtype=float).reshape(-1, 4), whole]).T
            share = _shares(boxes, x, y, x + w, y + h, w * h)
            of, box = np.nonzero(share >= SOFT_IOU)
            bounds, shares, box = np.searchsorted(of, np.arange(len(dets) + 1)).tolist(), share[of, box].tolist(), box.tolist()
        first = 0
        for index, found in frames:
            overlapped: dict[int, list[tuple[int, float]]] = {}
            for j in range(len(found)):
                for k in range(bounds[first + j], bounds[first + j + 1]):
                    t = holder[box[k]]
                    if t is not None and (shares[k] >= OBJECT_IOU or not (t.lost and t.enabled)):
                        overlapped.setdefault(t.slot, []).append((j, shares[k]))
            now = self._objects(found, index, overlapped)
            for t in now:
                if t.slot < len(at):
                    holder[at[t.slot]] = None
                    at[t.slot] = n + first + t.took
                else:
                    at.append(n + first + t.took)
                holder[at[t.slot]] = t
            first += len(found)
            yield now

    def far_enough(self, n_frames: int, n_dets: int) -> bool:
        """Whether so many frames are enough for ``objects_ahead``: what it tells at once is bounded."""
        return n_frames >= AHEAD_FRAMES or n_dets >= AHEAD_DETS or n_dets * (len(self.objects) + n_dets) > AHEAD_PAIRS

    @staticmethod
    def _chosen(t: Track, overlaps: list[tuple[int, float]], dets: list[dict]) -> int | None:
        """The detection that an object takes, of those that overlap it by as much as it takes to match."""
        best, at, soft, near = -1.0, None, -1.0, None
        for j, v in overlaps:
            far = _distance(t.shown, dets[j]["box"])
            if v >= OBJECT_IOU and 1000 * v - far > best:
                best, at = 1000 * v - far, j
            if far <= SOFT_PX and 1000 * v - far > soft:
                soft, near = 1000 * v - far, j
        return near if at is None and (not t.enabled or not t.lost) else at

    def _overlapped(self, dets: list[dict]) -> dict[int, list[tuple[int, float]]]:
        """By slot, the objects that overlap a detection by as much as it takes to match; with which ones, and by how much."""
        n = len(self.objects)
        if not n or not dets:
            return {}
        share = _shares(np.array([d["box"] for d in dets]), *self.boxes[:5, :n])
        found: dict[int, list[tuple[int, float]]] = {}
        if len(at := np.flatnonzero(share >= self.boxes[5, :n])):
            for k, v in zip(at.tolist(), share.ravel()[at].tolist(), strict=True):
                j, i = divmod(k, n)
                found.setdefault(i, []).append((j, v))
        return found

    # -- identities --
    def enrol(self, e: list[float] | None) -> int:
        if not e:
            return -1
        self.gallery.append({"id": self.next_identity, "e": _unit(e), "n": 1})
        self.next_identity += 1
        self.known = None
        return self.gallery[-1]["id"]

    def add_sample(self, identity: int, e: list[float] | None) -> None:
        self.known = None
        for g in self.gallery:
            if e and g["id"] == identity:
                u, n = _unit(e), g["n"]
                same = len(u) == len(g["e"])
                g["e"], g["n"] = (_unit([(a * n + b) / (n + 1) for a, b in zip(g["e"], u, strict=True)]), n + 1) if same else (u, 1)

    def query(self, e: list[float]) -> tuple[int, float]:
        u, best = _unit(e), (-1, 0.0)
        if self.known is None or self.known[0] != (len(u), len(self.gallery)):
            same = [g for g in self.gallery if len(g["e"]) == len(u)]
            self.known = (len(u), len(self.gallery)), same, np.array([g["e"] for g in same])
        _, same, vectors = self.known
        if same:
            about = vectors @ np.array(u)
            top = about.max()
            same = [same[i] for i in np.flatnonzero(about >= top - 1e-9)] if np.isfinite(top) else same
        for g in same:  # nearly equal ones are told apart exactly
            s = sum(a * b for a, b in zip(u, g["e"], strict=True))
            best = (g["id"], s) if s > best[1] else best
        return best

    def _link(self, t: Track, identity: int, tier: int) -> None:
        t.identity, t.tier, t.enabled = identity, tier, tier == SUGGESTED
        t.label = f"{ {ENROLLED: 'Keep', LINKED: 'Auto', SUGGESTED: 'Maybe keep'}[tier] } #{identity if identity > 0 or tier == SUGGESTED else t.id}"

    def _release(self, t: Track) -> None:
        t.forced, t.tier, t.identity, t.enabled, t.label = False, NONE, -1, True, f"Face #{t.id}"

    def _policy(self, frame: int) -> None:
        if not self.keep or not self.gallery:
            return
        for t in self.faces:
            linked, check = t.tier in (ENROLLED, LINKED), frame % CHECK_EVERY == 0
            if t.rejected or not (check or (not linked and t.start == frame)):
                continue
            if min(t.shown[2:]) < LEAST_SIDE or not t.e:
                if not linked:
                    self._release(t)
                continue
            identity, score = self.query(t.e)
            if score >= KEEP:
                self._link(t, identity, ENROLLED if t.forced else LINKED)
            elif linked and score >= SUGGEST:
                continue
            elif not linked and score >= SUGGEST:
                self._link(t, identity, SUGGESTED)
            else:
                self._release(t)

    # -- commands --
    def command(self, op: str, args: dict) -> None:
        self.stale = True
        t = self._by_id(int(args.get("id", -1)))
        if op == "enable" and t:
            t.enabled, t.forced = bool(args["enabled"]), t.forced or bool(args.get("forced"))
            if self.keep and t.kind == FACE and not t.enabled and t.e:
                self._link(t, self.enrol(t.e), ENROLLED)
        elif op == "enrol" and t:
            if t.identity > 0:
                self.add_sample(t.identity, t.e)
            else:
                t.identity = self.enrol(t.e)
            t.forced = True
            self._link(t, t.identity, ENROLLED)
        elif op == "confirm" and t and t.identity >= 0:
            self.add_sample(t.identity, t.e)
            t.forced = True
            self._link(t, t.identity, ENROLLED)
        elif op == "reject" and t:
            t.rejected, t.tier, t.identity, t.enabled, t.label = True, NONE, -1, True, f"Face #{t.id}"
        elif op == "policy":
            self.keep = args["policy"] == "keep"
            if not self.keep:
                self.gallery, self.known = [], None
                for x in self.tracks:
                    x.enabled = True
        elif op == "clear_gallery":
            self.gallery, self.known = [], None
        elif op == "reset":
            self.__dict__.update(Video(keep=self.keep).__dict__)

    def break_continuity(self) -> None:
        self._lose(self.faces)
        self.live, self.faces = [], []

    def advance(self, index: int, faces: list[dict], objects: list[dict], heads: list[dict], commands: list[dict]) -> tuple[list[Track], set[int]]:
        """One frame: commands, jump, faces, objects, edges, policy; what is visible then, by id, and which ids newly appear."""
        for c in sorted(commands, key=lambda c: c["seq"]):
            self.command(c["op"], json.loads(c["args"] or "{}"))
        if self.keep and self.last is not None and (index > self.last + 1 or index < self.last):
            self.break_continuity()
        self.last = index
        if self.stale:
            self._sort_out()
        self._faces(faces, heads, index)
        self._objects(objects, index)
        seen = [t for t in self.faces if t.miss <= MASKED]
        seen = sorted(seen + self.present, key=_ID) if seen else self.present
        now = [t.id for t in seen if t.enabled]
        fresh = set(now).difference(self.was)
        self.was = now
        self._policy(index)
        return seen, fresh

    def frame(self, index: int, faces: list[dict], objects: list[dict], heads: list[dict], commands: list[dict]) -> list[tuple]:
        """The rows of what is visible on a frame."""
        seen, fresh = self.advance(index, faces, objects, heads, commands)
        return [(index, t.id, t.kind, *t.shown, float(t.score), t.enabled, t.miss, t.tier, t.identity, t.label, t.id in fresh) for t in seen]


def _boxes(rows) -> list[dict]:
    return [{"box": [float(r[c]) for c in "xywh"], "score": float(r["score"] or 0), "label": r["label"], "e": None if r["e"] is None else [float(x) for x in r["e"]]} for r in (rows if rows is not None else [])]


def run_frame(video: Video, row) -> list[tuple]:
    """One row of FRAMES through a video's state."""
    commands = [{"seq": c["seq"], "op": c["op"], "args": c["args"]} for c in (row.commands if row.commands is not None else [])]
    return video.frame(int(row.frame_index), _boxes(row.faces), _boxes(row.objects), _boxes(row.heads), commands)


COLUMNS = [c.split()[0] for c in OUT.split(", ")]


_TYPES = dict(zip(COLUMNS, [pa.string(), pa.int64(), *[pa.int32()] * 6, pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.bool_()], strict=True))
_HELD = ["track_id", "kind", "x", "y", "w", "h", "score", "enabled", "tier", "identity_id", "label"]
PART_ROWS = 100_000  # fixed value: rows of one piece of output


class _Rows:
    """Output by columns. What is known of a track is written once for as long as it stays so; frames point to it."""

    def __init__(self) -> None:
        self.serial = 0
        self._start()

    def _start(self) -> None:
        self.serial += 1
        self.held, self.at, self.miss, self.fresh, self.frames = [], [], [], [], []

    def add(self, video_id: str, index: int, seen: list[Track], fresh: set[int]) -> None:
        for t in seen:
            if t.part != self.serial or t.kind == FACE:
                t.part, t.row = self.serial, len(self.held)
                self.held.append((t.id, t.kind, *t.shown, float(t.score), t.enabled, t.tier, t.identity, t.label))
        self.at += [t.row for t in seen]
        self.miss += [t.miss for t in seen]
        self.fresh += [t.id in fresh for t in seen] if fresh else [False] * len(seen)
        self.frames.append((video_id, index, len(seen)))

    def take(self) -> pa.RecordBatch:
        held = {n: pa.array(c, _TYPES[n]) for n, c in zip(_HELD, zip(*self.held, strict=True), strict=True)} if self.held else {n: pa.array([], _TYPES[n]) for n in _HELD}
        at = pa.array(self.at, pa.int32())
        cols = {n: c.take(at) for n, c in held.items()}
        video, index, n = zip(*self.frames, strict=True)
        of = pa.array(np.repeat(np.arange(len(n)), n))
        cols |= {"video_id": pa.array(video, pa.string()).take(of), "frame_index": pa.array(index, pa.int64()).take(of), "miss": pa.array(self.miss, pa.int32()), "appeared": pa.array(self.fresh, pa.bool_())}
        self._start()
        return pa.RecordBatch.from_arrays([cols[c] for c in COLUMNS], names=COLUMNS)


def _listed(col: pa.Array) -> tuple[list[int], list[int], list[dict]]:
    """Where each row's boxes begin and end, and the boxes."""
    offsets, found = col.offsets.to_numpy(), col.values
    low, high = int(offsets[0]), int(offsets[-1])
    found = found.slice(low, high - low)
    none = col.is_null().to_numpy(zero_copy_only=False)
    ends = np.where(none, offsets[:-1], offsets[1:]) - low
    x, y, w, h, score, label = (found.field(c).to_pylist() for c in ("x", "y", "w", "h", "score", "label"))
    e = found.field("e")
    e = [None] * len(x) if e.null_count == len(x) else e.to_pylist()
    boxes = [{"box": [float(a), float(b), float(c), float(d)], "score": float(s or 0), "label": n, "e": v} for a, b, c, d, s, n, v in zip(x, y, w, h, score, label, e, strict=True)]
    return (offsets[:-1] - low).tolist(), ends.tolist(), boxes


NOWHERE = object()


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    video, at, rows = Video(), NOWHERE, _Rows()
    for b in batches:
        lists = [_listed(b.column(c)) for c in ("faces", "objects", "heads")]
        ids, index, commands = (b.column(c).to_pylist() for c in ("video_id", "frame_index", "commands"))
        until = b.column("until").to_pylist() if "until" in b.schema.names else None
        for i in range(b.num_rows):
            if ids[i] != at:
                video, at = Video(), ids[i]
            if until is not None and (until[i] is None or index[i] > until[i]):
                video.no_more_commands()
            rows.add(at, index[i], *video.advance(index[i], *(boxes[starts[i] : ends[i]] for starts, ends, boxes in lists), commands[i] or []))
            if len(rows.at) >= PART_ROWS:
                yield rows.take()
    if rows.frames:
        yield rows.take()


# Without commands a face never minds an object, so each kind is a fold of its own, and an object's rows differ by their frame only
# from one detection to the next: SPANS, with the frames that it is seen on. ``nth`` numbers a kind's tracks.
NO_COMMANDS = {"commands": False}
SPANS = "video_id string, kind int, born long, nth int, frames array<long>, miss int, x int, y int, w int, h int, score double, label string, appeared boolean"
_SPAN_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.int32()] * 5, pa.float64(), pa.string(), pa.bool_()]


class _Spans:
    """One kind of a video, frame by frame."""

    def __init__(self, video_id: str | None, kind: int, out: list[tuple]) -> None:
        self.video_id, self.kind, self.out = video_id, kind, out
        self.video, self.was, self.n = Video(), set(), 0
        self.video.no_more_commands()
        self.video.placed, self.wait, self.waiting = kind == FACE, [], 0  # frames to be told at once, and how many detections they have
        self.since, self.times, self.first = {}, [], 0  # objects seen now, from which frame on; the frames from ``first`` on

    def _row(self, t: Track, frames: list[int], appeared: bool) -> None:
        x, y, w, h = t.shown
        self.out.append((self.video_id, self.kind, t.born, t.id, frames, t.miss if self.kind == FACE else 0, x, y, w, h, float(t.score), t.label.rsplit(" #", 1)[0], appeared))

    def faces(self, index: int, dets: list[dict], heads: list[dict]) -> None:
        self.video._faces(dets, heads, index)
        seen = [t for t in self.video.faces if t.miss <= MASKED]
        for t in seen:
            if t.born < 0:
                t.born = self.n
            self._row(t, [index], t.id not in self.was)
        self.was = {t.id for t in seen}
        self.n += 1

    def _close(self, was: tuple, end: int) -> None:
        row, start = was
        self.out.append((*row[:4], self.times[start - self.first : min(end, start + LIFE + 1) - self.first], *row[4:]))

    def objects(self, index: int, dets: list[dict]) -> None:
        self.wait.append((index, dets))
        self.waiting += len(dets)
        if self.video.far_enough(len(self.wait), self.waiting):
            self._go_on()

    def _go_on(self) -> None:
        for (index, _), now in zip(self.wait, self.video.objects_ahead(self.wait), strict=True):
            for t in now:
                if t.born < 0:
                    t.born = self.n
                if was := self.since.get(t.id):
                    self._close(was, self.n)
                back = was is None or self.n > was[1] + LIFE + 1  # it was gone for a frame at least
                self.since[t.id] = (self.video_id, OBJECT, t.born, t.id, 0, *t.shown, float(t.score), t.label.rsplit(" #", 1)[0], back), self.n
            self.times.append(index)
            self.n += 1
            if len(self.times) >= 20 * LIFE:
                self._let_go(lambda start: self.n > start + LIFE + 1)
                self.times, self.first = self.times[-LIFE - 2 :], self.n - LIFE - 2
        self.wait, self.waiting = [], 0

    def _let_go(self, which) -> None:
        for i in [i for i, was in self.since.items() if which(was[1])]:
            self._close(self.since.pop(i), self.n)

    def close(self) -> None:
        self._go_on()
        self._let_go(lambda start: True)


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SPANS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _SPAN_TYPES, strict=True)], names=names)


def _run_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    fold, at = None, NOWHERE
    for b in batches:
        faces, objects, heads = (_listed(b.column(c)) for c in ("faces", "objects", "heads"))
        of = lambda listed, i: listed[2][listed[0][i] : listed[1][i]]
        for i, (video_id, kind, index) in enumerate(zip(*(b.column(c).to_pylist() for c in ("video_id", "kind", "frame_index")), strict=True)):
            if (video_id, kind) != at:
                if fold:
                    fold.close()
                fold, at = _Spans(video_id, kind, out), (video_id, kind)
            if kind == FACE:
                fold.faces(index, of(faces, i), of(heads, i))
            else:
                fold.objects(index, of(objects, i))
            if len(out) >= PART_ROWS:
                yield _span_batch(out)
                out.clear()
    if fold:
        fold.close()
    if out:
        yield _span_batch(out)


def _apart(rows: DataFrame) -> DataFrame:
    """The visible tracks of frames without commands: faces and objects in tasks of their own, numbered together by birth, faces first."""
    only = lambda kind, c: F.when(F.col("kind") == kind, F.col(c)).alias(c)
    parts = rows.select("*", F.explode(F.array(F.lit(FACE), F.lit(OBJECT))).alias("kind"))
    parts = parts.select("video_id", "frame_index", "kind", only(FACE, "faces"), only(OBJECT, "objects"), only(FACE, "heads"))
    spans = _in_order(parts, "video_id", "kind").mapInArrow(_run_apart, SPANS)
    number = F.dense_rank().over(Window.partitionBy("video_id").orderBy("born", "kind", "nth"))
    seen = spans.withColumn("track_id", number).select("*", F.posexplode("frames").alias("i", "frame_index"))
    made: dict[str, Column] = {
        "enabled": F.lit(True), "miss": F.col("miss") + F.col("i"), "tier": F.lit(NONE), "identity_id": F.lit(-1),
        "label": F.concat("label", F.lit(" #"), "track_id"), "appeared": F.col("appeared") & (F.col("i") == 0),
    }
    return seen.select(*(made.get(c, F.col(c)).alias(c) for c in COLUMNS))


COUNTS = "video_id string, frame_index long, masked long, appeared long, born long"


class _Counts:
    """One kind of a video, frame by frame: how many are visible, newly appear and are born. Where a face coasts changes none of these, so heads are not looked at."""

    def __init__(self, video_id: str | None, kind: int) -> None:
        self.video_id, self.kind, self.video, self.was = video_id, kind, Video(), set()
        self.video.no_more_commands()
        self.video.placed = False

    def _row(self, index: int, seen: set[int], born: int) -> tuple:
        fresh, self.was = len(seen - self.was), seen
        return self.video_id, index, len(seen), fresh, born

    def frames(self, frames: list[tuple[int, list[dict]]]) -> Iterator[tuple]:
        v = self.video
        if self.kind == OBJECT:
            first = v.next_id
            for (index, _), _ in zip(frames, v.objects_ahead(frames), strict=True):
                yield self._row(index, {t.id for t in v.present}, v.next_id - first)
                first = v.next_id
            return
        for index, dets in frames:
            first = v.next_id
            v._faces(dets, [], index)
            yield self._row(index, {t.id for t in v.faces if t.miss <= MASKED}, v.next_id - first)


def _by_frame(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Video, kind, frame and its boxes, from flat rows in order; a row without a box is a frame of the video."""
    at, dets = NOWHERE, []
    for b in batches:
        for video_id, kind, index, x, y, w, h, score in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (here := (video_id, kind, index)) != at:
                if at is not NOWHERE:
                    yield *at, dets
                at, dets = here, []
            if x is not None:
                dets.append({"box": [x, y, w, h], "score": score, "label": None, "e": None})
    if at is not NOWHERE:
        yield *at, dets


def _run_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, out, fold = [c.split()[0] for c in COUNTS.split(", ")], [], None
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), [pa.string(), *[pa.int64()] * 4], strict=True)], names=names)
    wait, n = [], 0
    for video_id, kind, index, dets in _by_frame(batches):
        if fold is None or (fold.video_id, fold.kind) != (video_id, kind):
            out += fold.frames(wait) if fold else []
            fold, wait, n = _Counts(video_id, kind), [], 0
        wait.append((index, dets))
        n += len(dets)
        if fold.video.far_enough(len(wait), n):
            out += fold.frames(wait)
            wait, n = [], 0
        if len(out) >= PART_ROWS:
            yield made()
            out = []
    out += fold.frames(wait) if fold else []
    if out:
        yield made()


def summary(faces: DataFrame, objects: DataFrame, heads: DataFrame) -> DataFrame:
    """Per video of flat detections without commands: frames with a visible track, tracks, visible rows, and those that newly appear.

    The same folds as in ``track``, but a frame leaves one as one row of counts, and boxes are shuffled once, flat. A track is visible on the frame that it is born on.
    """
    key = [F.col("video_id").cast("string").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index")]
    kinds = [F.lit(k).alias("kind") for k in (FACE, OBJECT)]
    box = [F.col(c).cast("double").alias(c) for c in "xywh"] + [F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")]
    ticks = faces.select(*key).unionByName(objects.select(*key)).unionByName(heads.select(*key)).distinct()
    rows = ticks.select("video_id", F.explode(F.array(*kinds)).alias("kind"), "frame_index", *(F.lit(None).cast("double").alias(c) for c in ("x", "y", "w", "h", "score")))
    for d, kind in zip((faces, objects), kinds, strict=True):
        rows = rows.unionByName(d.select(key[0], kind, key[1], *box))
    counts = _in_order(rows, "video_id", "kind", then=["frame_index", "x", "y", "w", "h", "score"]).mapInArrow(_run_counts, COUNTS)
    frames = counts.where("masked > 0").groupBy("video_id", "frame_index").agg(*(F.sum(c).alias(c) for c in ("born", "masked", "appeared")))
    return frames.groupBy("video_id").agg(F.count("frame_index").alias("frames"), F.sum("born").alias("tracks"), F.sum("masked").alias("masked"), F.sum("appeared").alias("appeared"))


def _in_order(rows: DataFrame, *keys: str, then: tuple[str, ...] | list[str] = ("frame_index",)) -> DataFrame:
    """Rows by frame within keys. Ranges, not hashes, and more of them than tasks at once: keys with many rows get tasks of their own."""
    n = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, *then)


def frames(faces: DataFrame, objects: DataFrame | None = None, heads: DataFrame | None = None, commands: DataFrame | None = None) -> DataFrame:
    """Rows of FRAMES from flat detections (video_id, frame_index, x, y, w, h, score and perhaps label, e) and commands (video_id, frame_index, seq, op, args).

    ``until`` is the frame of a video's last command, null for none; a stream, which cannot know it, does not ask for it.
    Its metadata say so where no video has commands.
    """

    def listed(d: DataFrame, name: str) -> DataFrame:
        has = lambda c, kind: F.col(c).cast(kind) if c in d.columns else F.lit(None).cast(kind)
        box = F.struct(*(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")), F.coalesce(has("score", "double"), F.lit(0.0)).alias("score"), has("label", "string").alias("label"), has("e", "array<double>").alias("e"))
        return d.groupBy(F.col("video_id").cast("string").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index")).agg(F.sort_array(F.collect_list(box)).alias(name))

    key = ["video_id", "frame_index"]
    out = listed(faces, "faces")
    for d, name in ((objects, "objects"), (heads, "heads")):
        out = out.join(listed(d, name), key, "full_outer") if d is not None else out.withColumn(name, F.lit(None).cast(f"array<{BOX}>"))
    if commands is not None:
        c = commands.groupBy(F.col("video_id").cast("string").alias("video_id"), F.col("frame_index").cast("long").alias("frame_index")).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").cast("long").alias("seq"), "op", "args"))).alias("commands"))
        out = out.join(c, key, "full_outer").join(c.groupBy("video_id").agg(F.max("frame_index").alias("until")), "video_id", "left")
    else:
        out = out.withColumn("commands", F.lit(None).cast("array<struct<seq:long,op:string,args:string>>")).withColumn("until", F.lit(None).cast("long").alias("until", metadata=NO_COMMANDS))
    return out.select(*key, "faces", "objects", "heads", "commands", "until")


def track(rows: DataFrame) -> DataFrame:
    """The visible tracks of every frame. A video is one ordered fold, or one of each kind where there are no commands; it is streamed in batches."""
    if "until" in rows.columns and rows.schema["until"].metadata == NO_COMMANDS:
        return _apart(rows)
    return _in_order(rows, "video_id").mapInArrow(_run, OUT)
