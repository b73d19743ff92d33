"""Multi-object tracking of boxes, one tracker for each camera and label."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

TRACK_FIELDS = "frame_no long, track_id long, x1 double, y1 double, x2 double, y2 double, score double"


def iou_table(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    shared = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda v: np.clip(v[:, 2:] - v[:, :2], 0, None).prod(axis=1)
    return shared / (size(a)[:, None] + size(b)[None, :] - shared + 1e-9)


class Tracker:
    """Boxes move on with their smoothed velocity; confident boxes are matched first, faint ones only go on with tracks.

    Pairs are taken greedily by overlap. A track is reported once it was seen ``min_hits`` times and dropped when unseen
    for more than ``max_age`` frames.
    """

    def __init__(self, max_age: int = 30, min_hits: int = 3, least_iou: float = 0.3, high: float = 0.5, low: float = 0.1):
        self.max_age, self.min_hits, self.least_iou, self.high, self.low = max_age, min_hits, least_iou, high, low
        self.next_id, self.tracks = 1, []

    @classmethod
    def from_state(cls, text: str, **options) -> Tracker:
        out, held = cls(**options), json.loads(text)
        out.next_id, out.tracks = held["next"], held["tracks"]
        return out

    def state(self) -> str:
        return json.dumps({"next": self.next_id, "tracks": self.tracks})

    def _match(self, tracks: list[dict], boxes: np.ndarray, scores: np.ndarray) -> tuple[list[dict], list[int]]:
        """Tracks and boxes left over; matched tracks are brought up to date."""
        free_t, free_b = set(range(len(tracks))), set(range(len(boxes)))
        if tracks and len(boxes):
            table = iou_table(np.array([t["box"] for t in tracks]), boxes)
            for at in np.argsort(-table, axis=None, kind="stable"):
                i, j = divmod(int(at), len(boxes))
                if table[i, j] < self.least_iou:
                    break
                if i in free_t and j in free_b:
                    free_t.remove(i)
                    free_b.remove(j)
                    t, new = tracks[i], boxes[j]
                    t["v"] = (0.5 * (new - np.array(t["box"])) + 0.5 * np.array(t["v"])).tolist()
                    t |= {"box": new.tolist(), "score": float(scores[j]), "hits": t["hits"] + 1, "age": 0}
        return [tracks[i] for i in sorted(free_t)], sorted(free_b)

    def frame(self, boxes: np.ndarray, scores: np.ndarray) -> list[dict]:
        for t in self.tracks:
            t["box"] = (np.array(t["box"]) + np.array(t["v"])).tolist()
            t["age"] += 1
        sure = scores >= self.high
        faint = (scores >= self.low) & ~sure
        rest, born = self._match(self.tracks, boxes[sure], scores[sure])
        self._match(rest, boxes[faint], scores[faint])
        for j in born:
            self.tracks.append({"id": self.next_id, "box": boxes[sure][j].tolist(), "v": [0.0] * 4, "score": float(scores[sure][j]), "hits": 1, "age": 0, "ok": False})
            self.next_id += 1
        for t in self.tracks:
            t["ok"] = t["ok"] or t["hits"] >= self.min_hits
        self.tracks = [t for t in self.tracks if t["age"] <= self.max_age]
        return [t for t in self.tracks if t["ok"]]

    def run(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for frame_no, own in rows.groupby("frame_no", sort=True):
            for t in self.frame(own[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), own["score"].to_numpy(dtype=float)):
                out.append((int(frame_no), t["id"], *t["box"], t["score"]))
        return pd.DataFrame(out, columns=["frame_no", "track_id", "x1", "y1", "x2", "y2", "score"])


def track(frames: DataFrame, keys: Sequence[str] = ("camera_id", "label"), **options) -> DataFrame:
    """Confirmed tracks of each frame, keyed as given (batch twin of the stream). A task holds one batch, one frame and the tracks."""
    schema = ", ".join([*(f"`{k}` {frames.schema[k].dataType.simpleString()}" for k in keys), TRACK_FIELDS])
    names = [*keys, "frame_no", "track_id", "x1", "y1", "x2", "y2", "score"]
    dealt = frames.where("frame_no is not null").select(*keys, "frame_no", "x1", "y1", "x2", "y2", "score", "det_id").repartition(*keys).sortWithinPartitions(*keys, "frame_no", "det_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, frame_no, boxes, scores, tracker = None, None, [], [], None

        def close() -> list[tuple]:
            found = tracker.frame(np.array(boxes, dtype=float), np.array(scores, dtype=float)) if boxes else []
            return [(*key, int(frame_no), t["id"], *t["box"], t["score"]) for t in found]

        for part in batches:
            out = []
            own_keys = zip(*(part[k].astype(object).where(part[k].notna(), None) for k in keys), strict=True) if keys else ((),) * len(part)
            for own, no, box, score in zip(own_keys, part["frame_no"], part[["x1", "y1", "x2", "y2"]].to_numpy(dtype=float), part["score"], strict=True):
                if own != key or no != frame_no:
                    out += close()
                    if own != key:
                        key, tracker = own, Tracker(**options)
                    frame_no, boxes, scores = no, [], []
                boxes.append(box)
                scores.append(score)
            yield pd.DataFrame(out, columns=names)
        if boxes:
            yield pd.DataFrame(close(), columns=names)

    return dealt.mapInPandas(run, schema)
