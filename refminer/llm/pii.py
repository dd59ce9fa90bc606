"""Personal data: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans.

Every character of a text goes through both LSTMs, in overlapping windows; a character's tag scores come from the window
in whose middle it lies. One Viterbi decode over the whole document then reconciles the windows. Stretches in which no
run of other tags can outweigh O, whatever the transitions, are O on the best path for certain; the decode runs on the
rest, which gives the same path. Gates are piecewise linear and the squashing is x / (1 + |x|): numpy computes these
several times faster than exponentials.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refminer.llm import batches
from refminer.llm.storage import ensure_checkpoint_dir

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SSN", "IBAN")
TAGS = 1 + 2 * len(KINDS)
#: ASCII codes, all other characters, and what is outside a text.
OTHER, VOCABULARY = 128, 129
HIDDEN = 16
CORE, MARGIN = 768, 64
CHUNK = 1 << 19
#: Windows that are computed at a time, so that memory for states doesn't grow with a text.
WINDOWS = 768

_STOP = "the and of to in is that for with de la que el en les des et un der die und das von zu".split()
_SYLLABLES = (
    "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ing ion ent tion ment ble shi wh ly "
    "sch ein ung heit keit lich ge be ver au eau eux elle oi ai ié ré ér ión ado mente ez ñ ll qu ch pf tz ß ö ä ü è ç ê ó í"
).split()
_HOSTS = "mail example web post inbox firma correo courriel site corp home data uni lab".split()
_ENDS = "com org net de fr es io eu info co.uk example.com example.org".split()


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _word(rng: random.Random) -> str:
    return rng.choice(_STOP) if rng.random() < 0.3 else "".join(rng.choices(_SYLLABLES, k=rng.choice((1, 2, 2, 3, 3, 4, 6))))


def _filled(rng: random.Random, pattern: str) -> str:
    return "".join(rng.choice("0123456789") if c == "#" else c for c in pattern)


def sample_value(rng: random.Random, kind: str) -> str:
    if kind == "EMAIL":
        local = _word(rng) + rng.choice(["", "." + _word(rng), "." + _digits(rng, 2), "_" + _word(rng), _digits(rng, rng.randint(1, 4)), "." + _digits(rng, 2), "-" + _word(rng), "+" + _word(rng)])
        host = rng.choice([rng.choice(_HOSTS) + rng.choice(["", _digits(rng, 1), _digits(rng, 2)]), _word(rng)])
        return f"{local}@{host}.{rng.choice(_ENDS)}"
    if kind == "PHONE":
        return _filled(rng, rng.choice(["+1 (###) 555-####", "+1 (###) ###-####", "(###) ###-####", "###-###-####", "+49 ## #######", "+49 ### ########", "+33 # ## ## ## ##", "+34 ### ### ###", "+44 ## #### ####", "+1-###-###-####", "+1 ### ### ####"]))
    if kind == "IP":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "CARD":
        return _filled(rng, rng.choice(["################"] * 5 + ["#### #### #### ####", "####-####-####-####", "#### ###### #####"]))
    if kind == "SSN":
        return _filled(rng, "###-##-####")
    plain = rng.choice(["DE", "FR", "ES", "GB", "NL", "AT"]) + _digits(rng, rng.choice((18, 20, 22)))
    return plain if rng.random() < 0.5 else " ".join(plain[k : k + 4] for k in range(0, len(plain), 4))


def _harmless(rng: random.Random) -> str:
    hexadecimal = "".join(rng.choices("0123456789abcdef", k=rng.choice((8, 12, 32, 40, 40, 40, 64))))
    return rng.choice([
        str(rng.randint(1900, 2050)), str(rng.randint(0, 99)), _digits(rng, rng.randint(3, 11)), f"{rng.randint(0, 99)}.{rng.randint(0, 9)}", f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}",
        f"{rng.randint(2000, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", f"{rng.randint(0, 23)}:{rng.randint(0, 59):02}",
        f"${rng.randint(1, 999)},{rng.randint(100, 999)}.{rng.randint(10, 99)}", f'token = "{hexadecimal}"', hexadecimal, f"https://{_word(rng)}.{rng.choice(_ENDS)}/{_word(rng)}/{rng.randint(1, 999)}", "@" + _word(rng),
        f"{rng.randint(1, 99)}-{rng.randint(1, 99)}", "version 3.", "CC BY-NC 4.0.", "Version 2.0.", f"{_word(rng)}.{_word(rng)}", f"({rng.randint(1, 200)})", f"#{rng.randint(1, 9999)}", f"{_digits(rng, 3)},{_digits(rng, 3)},{_digits(rng, 3)}", f"Gl{_digits(rng, 2)}a",
    ])


def labelled_text(rng: random.Random, length: int) -> tuple[str, np.ndarray]:
    """A text of more than length characters and its tags: 0, or 1 + 2 kind at the first and 2 + 2 kind at the other characters of a span."""
    style = rng.choices(("plain", "shout", "symbols", "table"), (6, 1.5, 1.5, 1.5))[0]
    pieces: list[str] = []
    tags: list[int] = []
    n = 0
    density = rng.choice((0.0, 0.05, 0.15, 0.3))
    while n <= length:
        pick, kind = rng.random(), -1
        if pick < density:
            kind = rng.randrange(len(KINDS))
            text = sample_value(rng, KINDS[kind])
        elif pick < density + 0.1:
            text = _harmless(rng)
        else:
            text = _word(rng)
            if rng.random() < 0.12:
                text = text.capitalize()
        if style == "shout":
            text = text.upper()
        tail = {"plain": rng.choice([" "] * 8 + [", ", ". ", ".\n", "\n"]), "shout": "!! ", "symbols": rng.choice(["*** ", "%%% ", "&&& ", "### ", "$$$ "]), "table": rng.choice([" | "] * 5 + ["\n"])}[style]
        if style == "plain" and kind >= 0 and rng.random() < 0.2:
            tail = rng.choice([") ", "; ", ": ", "\n", '" ', "> "])
        pieces += [text, tail]
        tags += ([1 + 2 * kind] + [2 + 2 * kind] * (len(text) - 1) if kind >= 0 else [0] * len(text)) + [0] * len(tail)
        n += len(text) + len(tail)
    return "".join(pieces), np.array(tags, np.int64)


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.minimum(codes, OTHER).astype(np.int64)


def training_windows(rng: random.Random, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    chars, tags = np.empty((count, width), np.int64), np.empty((count, width), np.int64)
    for k in range(count):
        inside = True
        while inside:  # no window begins or ends inside a span, as no text does
            text, own = labelled_text(rng, 2 * width)
            first = rng.randint(0, len(text) - width - 1) if rng.random() < 0.8 else 0
            inside = any(own[at] and own[at] % 2 == 0 for at in (first, first + width))
        chars[k], tags[k] = encode(text)[first : first + width], own[first : first + width]
    return chars, tags


@dataclass
class Model:
    """Weights of the two directions (first axis); gates in the order input, forget, output, candidate."""

    wx: np.ndarray
    wh: np.ndarray
    wo: np.ndarray
    bo: np.ndarray
    trans: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]


def initial(seed: int = 5, hidden: int = HIDDEN) -> Model:
    rng = np.random.default_rng(seed)
    wx = rng.normal(0, 0.3, (2, VOCABULARY, 4 * hidden))
    wx[:, :, hidden : 2 * hidden] += 1
    return Model(wx, rng.normal(0, 1 / np.sqrt(hidden), (2, hidden, 4 * hidden)), rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)), np.zeros(TAGS), np.zeros((TAGS, TAGS)))


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def _slope(gate: np.ndarray) -> np.ndarray:
    return 0.2 * ((gate > 0) & (gate < 1))


def loss_and_gradients(model: Model, chars: np.ndarray, tags: np.ndarray) -> tuple[float, Model]:
    """Mean negative log-likelihood of the tags of windows (rows x width) and its gradients by backpropagation through time."""
    rows, width = chars.shape
    h_size = model.wh.shape[1]
    both = np.stack([chars.T, chars.T[::-1]])
    direction = np.arange(2)[:, None]
    gates = np.empty((width, 2, rows, 4 * h_size))
    cells, states = np.zeros((width + 1, 2, rows, h_size)), np.zeros((width + 1, 2, rows, h_size))
    for t in range(width):
        z = model.wx[direction, both[:, t]] + states[t] @ model.wh
        z[..., : 3 * h_size] = np.clip(0.2 * z[..., : 3 * h_size] + 0.5, 0, 1)
        z[..., 3 * h_size :] = _squash(z[..., 3 * h_size :])
        gates[t] = z
        i, f, o, g = np.split(z, 4, axis=-1)
        cells[t + 1] = f * cells[t] + i * g
        states[t + 1] = o * _squash(cells[t + 1])
    hidden = np.concatenate([states[1:, 0], states[:0:-1, 1]], axis=-1)
    scores = hidden @ model.wo + model.bo
    # forward and backward weights of the CRF, each step scaled to sum 1; the scales add up to log_z
    top = scores.max(axis=-1, keepdims=True)
    weight, turn = np.exp(scores - top), np.exp(model.trans)
    alpha, beta, scale = np.empty_like(scores), np.ones_like(scores), np.empty((width, rows, 1))
    for t in range(width):
        alpha[t] = weight[t] if t == 0 else (alpha[t - 1] @ turn) * weight[t]
        scale[t] = alpha[t].sum(axis=1, keepdims=True)
        alpha[t] /= scale[t]
    ahead = weight / scale
    for t in range(width - 2, -1, -1):
        beta[t] = (ahead[t + 1] * beta[t + 1]) @ turn.T
    log_z = (np.log(scale) + top).sum(axis=0)[:, 0]
    at = np.arange(rows)
    steps = tags.T
    gold = scores[np.arange(width)[:, None], at, steps].sum(0) + model.trans[steps[:-1], steps[1:]].sum(0)
    d_scores = alpha * beta
    d_trans = turn * (alpha[:-1].reshape(-1, TAGS).T @ (ahead[1:] * beta[1:]).reshape(-1, TAGS))
    np.add.at(d_trans, (steps[:-1].ravel(), steps[1:].ravel()), -1)
    d_scores[np.arange(width)[:, None], at, steps] -= 1
    d_hidden = d_scores @ model.wo.T
    d_wo = hidden.reshape(-1, 2 * h_size).T @ d_scores.reshape(-1, TAGS)
    d_states = np.stack([d_hidden[:, :, :h_size], d_hidden[::-1, :, h_size:]], axis=1)
    d_h, d_c = np.zeros((2, rows, h_size)), np.zeros((2, rows, h_size))
    d_z = np.empty((width, 2, rows, 4 * h_size))
    squashed = _squash(cells[1:])
    bend = (1 - np.abs(squashed)) ** 2
    slopes = np.concatenate([_slope(gates[..., : 3 * h_size]), (1 - np.abs(gates[..., 3 * h_size :])) ** 2], axis=-1)
    back = model.wh.transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        i, f, o, g = np.split(gates[t], 4, axis=-1)
        d_h = d_h + d_states[t]
        d_c = d_c + d_h * o * bend[t]
        own = d_z[t]
        own[..., :h_size] = d_c * g
        own[..., h_size : 2 * h_size] = d_c * cells[t]
        own[..., 2 * h_size : 3 * h_size] = d_h * squashed[t]
        own[..., 3 * h_size :] = d_c * i
        own *= slopes[t]
        d_h = own @ back
        d_c = d_c * f
    d_wx, d_wh = np.zeros_like(model.wx), np.zeros_like(model.wh)
    for d in range(2):
        flat = d_z[:, d].reshape(-1, 4 * h_size)
        one_hot = np.zeros((len(flat), VOCABULARY))
        one_hot[np.arange(len(flat)), both[d].ravel()] = 1
        d_wx[d] = one_hot.T @ flat
        d_wh[d] = states[:-1, d].reshape(-1, h_size).T @ flat
    found = Model(d_wx, d_wh, d_wo, d_scores.sum((0, 1)), d_trans)
    for array in found.arrays():
        array /= rows
    return float((log_z - gold).mean()), found


def train(steps: int = 640, rows: int = 96, width: int = 72, rate: float = 0.02, seed: int = 11) -> Model:
    """Adam on freshly drawn labelled windows, with a falling rate and clipped gradients."""
    rng = random.Random(seed)
    model = initial()
    first = [np.zeros_like(a) for a in model.arrays()]
    second = [np.zeros_like(a) for a in model.arrays()]
    for step in range(1, steps + 1):
        _, grads = loss_and_gradients(model, *training_windows(rng, rows, width))
        norm = np.sqrt(sum(float((g**2).sum()) for g in grads.arrays()))
        scale, now = min(1.0, 5 / max(norm, 1e-9)), rate * (0.5 * (1 + np.cos(np.pi * step / steps)) + 0.02)
        for p, g, m, v in zip(model.arrays(), grads.arrays(), first, second, strict=True):
            g = g * scale
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


@cache
def default_model() -> Model:
    """Trained once in a process; the same weights every time."""
    return train()


def stored_model(spark: SparkSession) -> Model:
    """default_model, read from the shared folder if an earlier driver has trained and written it there."""
    key = hashlib.sha256(Path(__file__).read_bytes()).hexdigest()[:16]
    folder = f"{ensure_checkpoint_dir(spark)}/refminer-pii-{key}"
    try:
        rows = spark.read.parquet(folder).collect()
    except AnalysisException:  # not there
        rows = []
    if len(rows) == len(fields(Model)):
        found = {r.name: np.array(r.weights).reshape(r.shape) for r in rows}
        return Model(**found)
    model = default_model()
    weights = [(f.name, list(a.shape), a.ravel().tolist()) for f, a in zip(fields(Model), model.arrays(), strict=True)]
    spark.createDataFrame(weights, "name string, shape array<int>, weights array<double>").coalesce(1).write.mode("overwrite").parquet(folder)
    return model


class Tagger:
    def __init__(self, model: Model) -> None:
        h = model.wh.shape[1]
        scale, shift = np.ones(4 * h), np.zeros(4 * h)
        scale[: 3 * h], shift[: 3 * h] = 0.2, 0.5  # the linear part of the gates, once instead of at every character
        self.hidden = h
        # a table and a matrix for each direction and gate: rows of a table are copied whole, and each gate is one block of memory
        self.wx = np.ascontiguousarray((model.wx * scale + shift).reshape(2, VOCABULARY, 4, h).transpose(0, 2, 1, 3), np.float32)
        self.wh = np.ascontiguousarray((model.wh * scale).reshape(2, h, 4, h).transpose(0, 2, 1, 3), np.float32)
        self.wo, self.bo = np.ascontiguousarray(model.wo, np.float32), model.bo.astype(np.float32)
        self.trans = model.trans
        around = model.trans.copy()
        around[0, 0] = -np.inf
        #: The most that one transition to, from or between other tags than O gains over O to O.
        self.gain = max(0.0, float(around.max() - model.trans[0, 0]), -float(model.trans[0, 0]))

    def _run(self, d: int, chars: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """States (step, window, hidden) of one direction; the windows are ordered by falling length, reach[t] of them have step t."""
        h, steps, rows = self.hidden, len(reach), chars.shape[1]
        out = np.empty((steps, rows, h), np.float32)
        state, cell, size = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32), np.empty((rows, h), np.float32)
        z, x = np.empty((4, rows, h), np.float32), np.empty((4, rows, h), np.float32)
        for t in range(steps):
            n = int(reach[t])
            if n < len(size):
                state, cell, size, z, x = state[:n], cell[:n], size[:n], np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32)
            for gate in range(4):
                np.take(self.wx[d, gate], chars[t, :n], axis=0, out=x[gate], mode="clip")
            np.matmul(state, self.wh[d], out=z)
            z += x
            gates, candidate = z[:3], z[3]
            np.clip(gates, 0, 1, out=gates)
            np.abs(candidate, out=size)
            size += 1
            candidate /= size
            candidate *= z[0]
            cell *= z[1]
            cell += candidate
            np.abs(cell, out=size)
            size += 1
            state = out[t, :n]
            np.divide(cell, size, out=state)
            state *= z[2]
        return out

    def scores(self, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tag scores of all characters; row r's are codes[bounds[r]:bounds[r + 1]]."""
        sizes = np.diff(bounds)
        parts = -(-sizes // CORE)
        row = np.repeat(np.arange(len(sizes)), parts)
        core = bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * CORE
        core_end = np.minimum(core + CORE, bounds[row + 1])
        first, end = np.maximum(core - MARGIN, bounds[row]), np.minimum(core_end + MARGIN, bounds[row + 1])
        order = np.argsort(first - end, kind="stable")
        core, core_end, first, end = core[order], core_end[order], first[order], end[order]
        out = np.empty((len(codes), TAGS), np.float32)
        for k in range(0, len(core), WINDOWS):
            some = slice(k, k + WINDOWS)
            self._fill(out, codes, core[some], core_end[some], first[some], end[some])
        return out

    def _fill(self, out: np.ndarray, codes: np.ndarray, core: np.ndarray, core_end: np.ndarray, first: np.ndarray, end: np.ndarray) -> None:
        """Scores of the cores of some windows. What lies after a core is read backwards only, what lies before it forwards only."""
        h, rows, last = self.hidden, len(core), len(codes) - 1
        cores = list(zip(core.tolist(), core_end.tolist(), strict=True))
        directions = ((first, core_end - first, core - first), (end - 1, end - core, end - core_end))
        for d, (origin, lengths, skipped) in enumerate(directions):
            order = np.argsort(-lengths, kind="stable")
            place = np.empty(rows, np.int64)
            place[order] = np.arange(rows)
            steps = np.arange(int(lengths.max()))
            reach = np.searchsorted(-lengths[order], -steps, "left")
            at = origin[order][None, :] + (-steps if d else steps)[:, None]
            states = self._run(d, codes[np.clip(at, 0, last)], reach)
            weights = self.wo[d * h : (d + 1) * h]
            # window by window: its states are a view with a fixed stride, which needs no index or copy of all states
            for (start, stop), own, skip in zip(cores, place.tolist(), skipped.tolist(), strict=True):
                score = states[skip : skip + stop - start, own] @ weights
                if d:
                    out[start:stop] += score[::-1]
                else:
                    np.add(score, self.bo, out=out[start:stop])

    def decode(self, scores: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Best tags of each row under the transitions."""
        tags = np.zeros(len(scores), np.int64)
        if not len(scores):
            return tags
        # what a character adds at most to a run of other tags; a run gains if its sum and one more transition exceed 0
        best = scores[:, 1].copy()
        for tag in range(2, scores.shape[1]):
            np.maximum(best, scores[:, tag], out=best)
        worth = (best - scores[:, 0]).astype(np.float64) + self.gain
        total = np.concatenate([[0.0], np.cumsum(worth)])
        until = total[1:] - np.minimum.accumulate(total[:-1])
        since = np.maximum.accumulate(total[:0:-1])[::-1] - total[:-1]
        at = np.flatnonzero(until + since - worth + self.gain > -1e-3)
        if not len(at):
            return tags
        row = np.searchsorted(bounds, at, "right") - 1
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) > 1) | (np.diff(row) > 0)]))
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
            first, end, r = int(at[a]), int(at[b - 1]) + 1, int(row[a])
            score = scores[first].astype(np.float64) + (0.0 if first == bounds[r] else self.trans[0])
            back = []
            for t in range(first + 1, end):
                ways = score[:, None] + self.trans
                back.append(ways.argmax(axis=0))
                score = ways.max(axis=0) + scores[t]
            if end < bounds[r + 1]:
                score = score + self.trans[:, 0]
            tag = int(score.argmax())
            for t in range(end - 1, first, -1):
                tags[t] = tag
                tag = int(back[t - first - 1][tag])
            tags[first] = tag
        return tags

    def spans(self, codes: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, first character, end, kind) by row and place."""
        tags = self.decode(self.scores(codes, bounds), bounds)
        at = np.flatnonzero(tags)
        out: list[tuple[int, int, int, int]] = []
        for t, tag in zip(at.tolist(), tags[at].tolist(), strict=True):
            kind, inside = (tag - 1) // 2, tag % 2 == 0
            r = int(np.searchsorted(bounds, t, "right")) - 1
            if inside and out and out[-1][0] == r and out[-1][2] == t - bounds[r] and out[-1][3] == kind:
                out[-1] = (r, out[-1][1], t - int(bounds[r]) + 1, kind)
            else:
                out.append((r, t - int(bounds[r]), t - int(bounds[r]) + 1, kind))
        return out


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each character, character bounds of the rows) of UTF-8 bytes."""
    lead = (data & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    codes = data[lead]
    return np.minimum(codes, OTHER).astype(np.int64), count[offsets]


def _find(column: pa.Array, tagger: Tagger) -> Iterator[tuple[int, int, int, int]]:
    data, offsets = batches.text_buffers(column)
    for first, _, chunk, offs in batches.chunks(data, offsets, CHUNK):
        for row, start, end, kind in tagger.spans(*characters(chunk, offs)):
            yield first + row, start, end, kind


def find_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per span: doc_id, start and end (characters of the text, end excluded), kind.

    Null and empty texts have no span, a null doc_id stays null, repeated rows each give their spans, other columns are
    ignored. Of long texts all windows are read. The weights (some 80 KB) go along with the function.
    """
    weights = stored_model(docs.sparkSession) if model is None else model

    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights)
        for part in parts:
            found = list(_find(part.column("text"), tagger))
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            ids = part.column("doc_id").take(pa.array(cols[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([KINDS[k] for k in cols[3]], pa.string())], ["doc_id", "start", "end", "kind"])

    return batches.with_doc_columns(docs).mapInArrow(search, "doc_id bigint, start bigint, end bigint, kind string")


def mask_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"[{KINDS[kind]}]"]
        at = end
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets, and n_chars, where there is one, the new length.

    All rows, columns and their types stay. Null texts stay null.
    """
    weights = stored_model(docs.sparkSession) if model is None else model
    columns = docs.columns

    def replace(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(weights)
        for part in parts:
            column = part.column("text")
            by_row: dict[int, list[tuple[int, int, int]]] = {}
            for row, *span in _find(column, tagger):
                by_row.setdefault(row, []).append((span[0], span[1], span[2]))
            if by_row:
                changed = np.zeros(len(column), bool)
                changed[list(by_row)] = True
                masked = [mask_text(column[row].as_py(), by_row[row]) for row in sorted(by_row)]
                column = pc.replace_with_mask(column, pa.array(changed), pa.array(masked, column.type))
            yield pa.RecordBatch.from_arrays([column if name == "text" else part.column(k) for k, name in enumerate(columns)], columns)

    masked = docs.mapInArrow(replace, docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return masked
