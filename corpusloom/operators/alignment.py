"""Forced alignment of many utterances at once: one trellis step covers a batch of like length, and back-pointers are kept in checkpoints.

The path through a trellis of T frames needs the winning move of every state in every frame. Here only the scores of every
STEPS-th frame are kept on the way forward; on the way back each stretch is computed again from its checkpoint, so a batch holds
[T / STEPS] score vectors and [STEPS] rows of moves, not T of them. Results equal those of one utterance at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scores (frames x symbols) that a batch holds at most, unless one utterance alone has more.
BATCH_CELLS = 4 << 20

#: Names of the blank in a vocabulary, in the order in which they are looked for.
BLANKS = ["<blank>", "<pad>", "<s>"]
#: Arabic letters that a vocabulary of that script holds, and how many of them at least.
ARABIC_LETTERS, ARABIC_LEAST = "\u0627\u0628\u062a\u062c\u062f\u0631\u0633\u0645\u0646", 5


def blank_of(vocabulary: dict[str, int], pad_id: int | None = None) -> int:
    """The id of the blank: a symbol of BLANKS, else the padding id, else 0."""
    return next((vocabulary[b] for b in BLANKS if b in vocabulary), pad_id if pad_id is not None else 0)


def is_romanised(vocabulary: dict[str, int]) -> bool:
    """Whether targets must be romanised: the vocabulary lacks the Arabic script."""
    return sum(c in vocabulary for c in ARABIC_LETTERS) < ARABIC_LEAST


def fits(frames: int, targets: list[int]) -> bool:
    """Whether there are frames enough: one for each target, and one more."""
    return bool(targets) and frames > len(targets)


class _Trellis:
    def __init__(self, scores: list[np.ndarray], targets: list[list[int]], blank: int):
        self.frames = np.array([len(s) for s in scores])
        self.states = np.array([2 * len(t) + 1 for t in targets])
        b, n, t, v = len(scores), int(self.states.max()), int(self.frames.max()), scores[0].shape[1]
        self.scores = np.zeros((t, b, v))
        for i, s in enumerate(scores):
            self.scores[: len(s), i] = s
        self.label = np.full((b, n), blank)
        for i, own in enumerate(targets):
            self.label[i, 1 : 2 * len(own) : 2] = own
        self.inside = np.arange(n) < self.states[:, None]
        self.skips = np.zeros((b, n), bool)
        self.skips[:, 2:] = (self.label[:, 2:] != blank) & (self.label[:, 2:] != self.label[:, :-2])

    def emit(self, t: int) -> np.ndarray:
        return np.where(self.inside, np.take_along_axis(self.scores[t], self.label, 1), -np.inf)

    def start(self) -> np.ndarray:
        alpha = np.full(self.label.shape, -np.inf)
        alpha[:, :2] = self.emit(0)[:, :2]
        return alpha

    def step(self, alpha: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and moves at frame t: stay, move on by one, or skip a blank; of equal ones the first. Utterances that have ended stay."""
        moves = np.full((3, *alpha.shape), -np.inf)
        moves[0], moves[1, :, 1:] = alpha, alpha[:, :-1]
        moves[2, :, 2:] = np.where(self.skips[:, 2:], alpha[:, :-2], -np.inf)
        move = moves.argmax(0)
        new = np.take_along_axis(moves, move[None], 0)[0] + self.emit(t)
        on = (t < self.frames)[:, None]
        return np.where(on, new, alpha), np.where(on, move, 0).astype(np.int8)

    def paths(self) -> np.ndarray:
        """The state of each utterance in each frame [frames, utterances]; beyond an utterance's end its last state."""
        total = len(self.scores)
        steps = max(1, math.isqrt(total))
        kept, alpha = [], self.start()
        for t in range(1, total):
            if (t - 1) % steps == 0:
                kept.append(alpha)
            alpha, _ = self.step(alpha, t)
        rows, n = np.arange(len(self.states)), self.states
        at = np.where(alpha[rows, n - 1] >= alpha[rows, n - 2], n - 1, n - 2)
        path = np.empty((total, len(rows)), np.int64)
        path[-1] = at
        for k in range(len(kept) - 1, -1, -1):
            alpha, moves = kept[k], []
            for t in range(1 + k * steps, min(total, 1 + (k + 1) * steps)):
                alpha, move = self.step(alpha, t)
                moves.append(move)
            for j in range(len(moves) - 1, -1, -1):
                at = at - moves[j][rows, at]
                path[k * steps + j] = at
        return path


def align_batch(scores: list[np.ndarray], targets: list[list[int]], blank: int = 0) -> list[list[tuple[int, int, float]]]:
    """For each utterance the spans (first frame, end, mean score) of its targets; none for one that has no path, or whose targets aren't symbols."""
    symbols = {s.shape[1] for s in scores if s.ndim == 2 and len(s)}
    out: list[list[tuple[int, int, float]]] = [[] for _ in scores]
    good = [i for i, (s, t) in enumerate(zip(scores, targets, strict=True)) if s.ndim == 2 and fits(len(s), t) and all(0 <= x < s.shape[1] for x in t)]
    for v in symbols:
        own = [i for i in good if scores[i].shape[1] == v]
        if not own:
            continue
        path = _Trellis([scores[i] for i in own], [targets[i] for i in own], blank).paths()
        for k, i in enumerate(own):
            for j, target in enumerate(targets[i]):
                at = np.flatnonzero(path[: len(scores[i]), k] == 2 * j + 1)
                out[i].append((int(at[0]), int(at[-1]) + 1, float(scores[i][at[0] : at[-1] + 1, target].mean())) if len(at) else (-1, -1, float("-inf")))
    return out


ALIGNED = "array<struct<start:int,end:int,score:double>>"
_KIND = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def _matrix(frames: pa.ListScalar) -> np.ndarray:
    if not frames.is_valid or len(frames.values) == 0:
        return np.zeros((0, 0))
    inner = frames.values
    widths = np.unique(np.asarray(inner.value_lengths().fill_null(-1)))
    if len(widths) != 1 or widths[0] < 1 or inner.flatten().null_count:
        return np.zeros((0, 0))
    return np.asarray(inner.flatten(), np.float64).reshape(len(inner), -1)


def forced_align(rows: DataFrame, blank: int = 0) -> DataFrame:
    """uid, spans of rows (uid, scores array<array<double>>, targets array<int>), in batches of utterances of like length.

    Utterances that can't be aligned (no targets, too few frames, ragged or null scores, targets that aren't symbols) get no spans.
    """

    def run(batches):
        for b in batches:
            scores = [_matrix(s) for s in b.column("scores")]
            targets = [t or [] for t in b.column("targets").to_pylist()]
            targets = [[] if None in t else t for t in targets]
            out: list = [None] * b.num_rows
            group: list[int] = []
            for i in [*range(b.num_rows), -1]:
                cells = (len(group) + 1) * max([scores[j].size for j in [*group, i] if j >= 0], default=0)
                if group and (i < 0 or cells > BATCH_CELLS):
                    for j, spans in zip(group, align_batch([scores[j] for j in group], [targets[j] for j in group], blank), strict=True):
                        out[j] = [{"start": s, "end": e, "score": x} for s, e, x in spans]
                    group = []
                group.append(i)
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out, _KIND)], ["uid", "spans"])

    kind = rows.schema["uid"].dataType.simpleString()
    return rows.select("uid", F.col("scores").cast("array<array<double>>").alias("scores"), "targets").sortWithinPartitions(F.size("scores"), F.size("targets")).mapInArrow(run, f"uid {kind}, spans {ALIGNED}")
