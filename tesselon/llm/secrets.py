"""Secret scans: fixed patterns, and a character convolution network over every candidate in its context."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselon.llm._text import slices, utf8

#: The base patterns.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
ASSIGN_VALUE, ACCESS_LENGTH = 6, 20
KINDS = ("assign", "access", "hex", "model")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A candidate is a run of at least so many characters that keys are written in; if it has a digit, of so many.
CANDIDATE, CANDIDATE_WITH_DIGIT = 12, 8
#: The network sees so many characters before a place of the candidate, and so many from there on.
BEFORE, WITHIN = 24, 40
#: Long candidates are seen in windows so many characters apart, the last one with as many behind the candidate.
STEP = 16
WIDTH, FILTERS = 5, 24
#: Documents whose findings the network is trained on, at most, and generated findings.
MAX_FIT_DOCS, MAX_FIT_CHARS, GENERATED = 1500, 32_000, 3000
#: Share of the labelled secrets that the threshold must keep.
RECALL = 0.98
#: Windows that the network is asked about at once.
CHUNK = 1 << 13
_TOKEN = np.zeros(256, bool)
_TOKEN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
#: Character classes: lower g-z, lower a-f, upper, digit, = : quote blank - _ / . + other, non-ASCII, outside.
_CLASS = np.full(256, 13, np.uint8)
_CLASS[ord("g") : ord("z") + 1] = 0
_CLASS[ord("a") : ord("f") + 1] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _i, _set in enumerate((b"=", b":", b"\"'`", b" \t\n\r", b"-", b"_", b"/", b".", b"+")):
    _CLASS[[*_set]] = 4 + _i
_CLASS[128:] = 14
_CHANNELS = 17  # 15 classes, outside the text, inside the candidate


def encode(data: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each window, the classes of the places around ``at`` (15: outside its text, low .. high), and by 16
    more whether they are in the candidate, start .. end, as one byte each."""
    place = at[:, None] + np.arange(-BEFORE, WITHIN)
    seen = np.where((place >= low[:, None]) & (place < high[:, None]), _CLASS[data[np.clip(place, 0, len(data) - 1)]], np.uint8(15))
    return seen | (((place >= start[:, None]) & (place < end[:, None])).astype(np.uint8) << 4)


def windows(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(candidate, place) of the windows that cover each candidate and STEP characters behind it."""
    count = np.maximum(1, -((start - end + WITHIN - 2 * STEP) // STEP))
    owner = np.repeat(np.arange(len(start)), count)
    return owner, start[owner] + STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count))


@dataclass
class Network:
    """One convolution, maximum and mean over places, one hidden layer, a calibrated output."""

    conv: np.ndarray
    conv_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5
    #: On the findings that were held back for the threshold.
    recall: float = 0.0
    precision: float = 0.0

    def planes(self, codes: np.ndarray) -> np.ndarray:
        x = np.zeros((*codes.shape, _CHANNELS), np.float32)
        np.put_along_axis(x, (codes & 15)[..., None].astype(np.int64), 1, axis=2)
        x[..., 16] = codes >> 4
        return x

    def forward(self, codes: np.ndarray) -> tuple:
        x = self.planes(codes)
        wide = np.concatenate([x[:, i : x.shape[1] - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
        pre = wide @ self.conv + self.conv_bias
        act = np.maximum(pre, 0)
        top = act.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(axis=1)], axis=1)
        h = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return wide, act, top, pooled, h, h @ self.out + self.out_bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        """As forward, with the convolution looked up for two places at a time: codes have 32 values."""
        code = np.arange(32)
        taps = self.conv.reshape(WIDTH, _CHANNELS, FILTERS)
        one = taps[:, code & 15] + taps[:, 16, None] * (code >> 4)[:, None]
        two = [(one[i][:, None] + one[i + 1][None]).reshape(1024, FILTERS) for i in (0, 2)]
        last = one[4] + self.conv_bias
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(codes), 512):
            c = codes[i : i + 512].astype(np.int64)
            pair = c[:, :-1] * 32 + c[:, 1:]
            pre = two[0][pair[:, : 1 - WIDTH + 1]] + two[1][pair[:, 2:-1]] + last[c[:, WIDTH - 1 :]]
            act = np.maximum(pre, 0, out=pre)
            pooled = np.concatenate([act.max(axis=1), act.mean(axis=1)], axis=1)
            out.append(np.maximum(pooled @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias)
        return np.concatenate(out)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return self.calibrated(self.logits(codes))

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * z.astype(float) + self.shift)))


def train(codes: np.ndarray, owner: np.ndarray, labels: np.ndarray, seed: int = 5, epochs: int = 12) -> Network:
    """Fits the windows of four fifths of the findings by Adam; on the rest calibrates the largest output among
    each finding's windows, and sets the highest threshold that keeps RECALL.

    owner is the finding of each window, labels the label of each finding."""
    rng = np.random.default_rng(seed)
    shape = lambda *s: (rng.standard_normal(s) * np.sqrt(2 / s[0])).astype(np.float32)
    net = Network(shape(WIDTH * _CHANNELS, FILTERS), np.zeros(FILTERS, np.float32), shape(2 * FILTERS, 16), np.zeros(16, np.float32), shape(16, 1)[:, 0], np.float32(0))
    names = ("conv", "conv_bias", "hidden", "hidden_bias", "out", "out_bias")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    step = 0
    held = np.zeros(len(labels), bool)
    held[rng.permutation(len(labels))[max(1, len(labels) * 4 // 5) :]] = True
    if not held.any():
        held[:] = True
    fit, check = np.flatnonzero(~held[owner]), np.flatnonzero(held[owner])
    marks = labels[owner]
    for _ in range(epochs):
        fit = rng.permutation(fit)
        for i in range(0, len(fit), 128):
            rows = fit[i : i + 128]
            wide, act, top, pooled, h, z = net.forward(codes[rows])
            dz = ((1 / (1 + np.exp(-z)) - marks[rows]) / len(rows)).astype(np.float32)
            dh = np.outer(dz, net.out) * (h > 0)
            dp = dh @ net.hidden.T
            da = np.repeat(dp[:, None, FILTERS:] / act.shape[1], act.shape[1], axis=1)
            np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + dp[:, None, :FILTERS], 1)
            da *= act > 0
            flat = da.reshape(-1, FILTERS)
            grads = {"out": h.T @ dz, "out_bias": dz.sum(), "hidden": pooled.T @ dh, "hidden_bias": dh.sum(0), "conv": wide.reshape(-1, wide.shape[2]).T @ flat, "conv_bias": flat.sum(0)}
            step += 1
            for n in names:
                first[n] = 0.9 * first[n] + 0.1 * grads[n]
                second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                move = 0.003 * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-7)
                setattr(net, n, (getattr(net, n) - move).astype(np.float32))
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, owner[check], net.logits(codes[check]).astype(float))
    z, y = best[held], labels[held]
    scale, shift = 1.0, 0.0
    for _ in range(300):  # Platt scaling
        g = 1 / (1 + np.exp(-(scale * z + shift))) - y
        scale, shift = max(0.05, scale - 0.1 * float((g * z).mean() / (1 + (z * z).mean()))), shift - 0.1 * float(g.mean())
    net.slope, net.shift = scale, shift
    p = net.calibrated(z)
    kept = np.sort(p[y > 0])
    net.threshold = float(min(0.9, kept[int((1 - RECALL) * len(kept))] if len(kept) else 0.5))
    hit = p >= net.threshold
    net.recall, net.precision = float(hit[y > 0].mean()) if len(kept) else 0.0, float(y[hit].mean()) if hit.any() else 0.0
    return net


def candidates(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first byte, last byte + 1) of the candidates."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _TOKEN[data]
    starts, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    starts[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    digits = np.append(0, np.cumsum((data >= 48) & (data < 58)))
    long = (ends - starts >= CANDIDATE) | ((ends - starts >= CANDIDATE_WITH_DIGIT) & (digits[ends] > digits[starts]))
    starts, ends = starts[long], ends[long]
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def base_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(first byte, kind, last byte + 1), sorted; leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    for a, b in runs:  # what the other patterns match stands within a candidate
        part = text[a:b]
        found += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(part) if len(m[0]) >= ACCESS_LENGTH]
        found += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(part)]
    return sorted(found)


def meetings(base: list[tuple[int, int, int]], runs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each base span the first run that it overlaps and the one behind the last, and for each run whether a base span
    overlaps it. Runs are in order and apart, so both ends are looked up."""
    starts, ends = (np.array([r[i] for r in runs], np.int64) for i in (0, 1))
    low = np.searchsorted(ends, np.array([a for a, _, _ in base], np.int64), "right")
    high = np.maximum(low, np.searchsorted(starts, np.array([b for _, _, b in base], np.int64), "left"))
    change = np.zeros(len(runs) + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return low, high, np.cumsum(change)[:-1] > 0


#: What needs no network to be known as harmless: words, joined by what names and paths are joined by.
_PLAIN = re.compile(rb"[+/_.=-]*(([A-Z]?[a-z]+|[A-Z]+)[+/_.=-]+)*([A-Z]?[a-z]+|[A-Z]+)[+/_.=-]*")


def generated_findings(count: int, seed: int) -> list[tuple[bytes, int, int, int]]:
    """Findings made from rules, as (text, start, end, label): keys in telling contexts, and what looks like keys but is not."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    draw = lambda alphabet, n: "".join(pick(alphabet) for _ in range(n))
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    mixed = lower + lower.upper() + digits
    word = lambda: draw(lower, int(rng.integers(2, 9)))
    found = []
    for i in range(count):
        secret = i % 2 == 0
        if secret:
            value = pick(
                [
                    lambda: "ghp_" + draw(mixed, 36),
                    lambda: "sk-" + draw(mixed, 40),
                    lambda: "xoxb-" + draw(digits, 11) + "-" + draw(mixed, 24),
                    lambda: "AIza" + draw(mixed + "-_", 35),
                    lambda: "eyJ" + draw(mixed, 30) + "." + draw(mixed, 30),
                    lambda: draw(mixed + "+/", 40),
                    lambda: draw(mixed, int(rng.integers(20, 64))),
                    lambda: draw("0123456789abcdef", int(rng.integers(20, 65))),
                    lambda: "AKIA" + draw(lower.upper() + digits, 16),
                ]
            )()
            lead = pick(["key: ", "credential = ", "Authorization: Bearer ", "client_id=", "auth: ", "pwd=", "access key ", "private ", "KEY='", word() + " "])
        else:
            value = pick(
                [
                    lambda: "/".join(word() for _ in range(5)) + "/" + draw(digits, 4),
                    lambda: f"20{draw(digits, 2)}-0{pick('123456789')}-1{pick(digits)}T1{pick(digits)}:00".replace(":", "."),
                    lambda: "-".join(word() for _ in range(4)) + "-" + draw(digits, 3),
                    lambda: "_".join(word() for _ in range(4)) + draw(digits, 3),
                    lambda: word() + "." + word() + ".com/" + word() + "=" + draw(digits, 5),
                    lambda: "www." + word() + word() + "." + word() + "/" + draw(digits, 6),
                    lambda: word().title() + word().title() + word().title() + draw(digits, 4),
                    lambda: "v" + ".".join(draw(digits, 3) for _ in range(5)),
                    lambda: draw(digits, 10) + "." + draw(digits, 10) + word(),
                    lambda: word() + "=" + draw(digits, 9) + "." + word() + word(),
                    lambda: draw(digits, int(rng.integers(8, 20))),
                    lambda: ".".join(draw(digits, int(rng.integers(1, 4))) for _ in range(4)),
                    lambda: "+" + draw(digits, 2) + "-" + draw(digits, 3) + "-" + draw(digits, 4) + "-" + draw(digits, 4),
                    lambda: word() + draw(digits, 1) + "." + word() + pick([".com", ".org", ".net"]),
                    lambda: word() + word() + word() + pick(["", "."]),
                    lambda: "-".join(word() for _ in range(3)),
                    lambda: (word() + word() + word()).upper() + pick(["", "."]),
                    lambda: "_".join(word() for _ in range(3)).upper(),
                    lambda: word() + word() + "." + draw(digits, 2),
                    lambda: "/".join(word() for _ in range(4)) + "." + word(),
                    lambda: f"20{draw(digits, 2)}-0{pick('123456789')}-1{pick(digits)}",
                ]
            )()
            value = value if len(value) >= CANDIDATE else value + draw(digits if value[-1] in digits else lower, CANDIDATE - len(value))
            lead = pick(["see ", "at ", "file ", "https:/", "page ", "on ", "ref ", word() + " ", word() + ": ", "(", word() + "@"])
        before, after = " ".join(word() for _ in range(5)) + " " + lead, pick([" ", "\n", "'", ",", ". "]) + " ".join(word() for _ in range(4))
        if rng.random() < (0.1 if secret or not value.isupper() else 0.7):
            before, after = before.upper(), after.upper()
        text = (before + value + after).encode()
        found.append((text, len(before), len(before) + len(value), int(secret)))
    return found


def corpus_findings(texts: list[bytes]) -> list[tuple[bytes, int, int, int]]:
    """Findings of documents, as (text, start, end, label): candidates that overlap a base span are secrets, those
    that are plain words are not. Of others nothing is known, and they are left out."""
    found = []
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        _, starts, ends = candidates(data, np.array([0, len(data)]))
        runs = list(zip(starts.tolist(), ends.tolist(), strict=True))
        for (a, b), met in zip(runs, meetings(base_spans(text, runs), runs)[2].tolist(), strict=True):
            if met:
                found.append((text, a, b, 1))
            elif _PLAIN.fullmatch(text[a:b]):
                found.append((text, a, b, 0))
    return found


def encoded(findings: list[tuple[bytes, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, finding of each window, labels) to train on."""
    codes, owners = [np.zeros((0, BEFORE + WITHIN), np.uint8)], [np.zeros(0, np.int64)]
    for i, (text, a, b, _) in enumerate(findings):
        low = max(0, a - 2 * BEFORE)
        data = np.frombuffer(text[low : b + 2 * WITHIN], np.uint8)
        start, end = np.array([a - low]), np.array([b - low])
        owner, at = windows(start, end)
        codes.append(encode(data, np.zeros(1, np.int64), np.array([len(data)]), start, end, at))
        owners.append(owner + i)
    return np.concatenate(codes), np.concatenate(owners), np.array([label for *_, label in findings], np.float32)


def fit_network(docs: DataFrame, column: str, id_column: str, seed: int = 5) -> Network:
    """Trains on the findings of MAX_FIT_DOCS documents at most, picked by a hash among those with a base
    word, and on GENERATED findings. They are counted first, so that only the picked texts reach the driver."""
    text = F.col(column)
    near = text.contains("AKIA") | F.lower(text).rlike("passw|secret|token|api_?key")
    few = docs.where(near & (F.length(text) <= MAX_FIT_CHARS)).select(column, F.pmod(F.xxhash64(F.col(id_column).cast("string"), text), F.lit(1 << 30)).alias("_pick"))
    rate = min(1.0, MAX_FIT_DOCS / max(1, few.count()))
    picked = few.where(F.col("_pick") < int(rate * (1 << 30))).orderBy("_pick", column).limit(MAX_FIT_DOCS).collect()
    texts = [r[0].encode() for r in picked]
    known = corpus_findings(texts)
    plain = [f for f in known if not f[3]]
    rng = np.random.default_rng(seed)
    few_plain = [plain[i] for i in sorted(rng.permutation(len(plain))[:GENERATED].tolist())]
    return train(*encoded([f for f in known if f[3]] + few_plain + generated_findings(GENERATED, seed)), seed)


def _scan(network, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in slices(batches, column):
            offsets, data = utf8(batch.column(batch.schema.get_field_index(column)))
            whole = data.tobytes()
            row, starts, ends = candidates(data, offsets)
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            best = np.zeros(len(row))
            owner, places = windows(starts, ends)
            for i in range(0, len(owner), CHUNK):
                who = owner[i : i + CHUNK]
                asked = encode(data, offsets[row[who]], offsets[row[who] + 1], starts[who], ends[who], places[i : i + CHUNK])
                np.maximum.at(best, who, net.probability(asked))
            found: list[list[tuple[int, int, int, float]]] = []
            for r in range(batch.num_rows):
                at = int(offsets[r])
                text = whole[at : int(offsets[r + 1])]
                runs = [(int(starts[i]) - at, int(ends[i]) - at) for i in range(first[r], first[r + 1])]
                base = base_spans(text, runs)
                low, high, met = meetings(base, runs)
                score = best[first[r] : first[r + 1]]
                spans = [(a, k, b, float(score[i:j].max()) if i < j else None) for (a, k, b), i, j in zip(base, low.tolist(), high.tolist(), strict=True)]
                spans += [(runs[i][0], 3, runs[i][1], float(score[i])) for i in np.flatnonzero((score >= net.threshold) & ~met).tolist()]
                found.append(spans)
            spans_out = []
            for r, spans in enumerate(found):
                if spans:
                    text = whole[int(offsets[r]) : int(offsets[r + 1])]
                    if not text.isascii():  # places count code points
                        starts_here = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
                        place = lambda i, s=starts_here: int(s[i - 1]) if i else 0
                        spans = [(place(a), k, place(b), p) for a, k, b, p in spans]
                spans_out.append([{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, k, b, p in sorted(spans, key=lambda x: x[:3])])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans_out, kind)], names=[*batch.schema.names, "secrets"])

    return run


def find_secrets(docs: DataFrame, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents with secrets: an array of (kind, start, end, score), by start, then kind; ends are exclusive,
    places code points.

    Kinds assign, access and hex are what the fixed patterns match, leftmost and non-overlapping for each
    kind. A candidate is any run of 12 or more key characters, or of 8 or more with a digit, of whatever
    letters and digits; the network scores each one, those within a base match too, by the largest output
    of its windows, which cover the whole run, 24 characters before it and 16 behind it. Kind model is a
    candidate that overlaps no base match and scores at or above the threshold. score is the network's for
    the candidate that a span overlaps; null where a base match overlaps none, its value being shorter.

    The network learns from labelled findings: base matches of the corpus and generated keys are secrets;
    generated names, numbers, paths and addresses, and the corpus's plain words, are not. What no pattern
    matches is not taken for harmless. The threshold keeps 98 % of the secrets in a fifth held back.

    Whole texts are scanned, of any length, in windows; null and empty ones have none. Repeated rows are
    scanned alike; an empty table gives no rows, and the network is then trained on generated findings
    only. Other columns pass through; a column named secrets is replaced.

    Scale: one pass without a shuffle. The network is of fixed size; its training sample is bounded by
    MAX_FIT_DOCS documents of MAX_FIT_CHARS characters at most.
    """
    docs = docs.drop("secrets")
    network = docs.sparkSession.sparkContext.broadcast(fit_network(docs, column, id_column))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["secrets array<struct<kind:string,start:bigint,end:bigint,score:double>>"])
    return docs.mapInArrow(_scan(network, column), schema)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the fixed kinds, the digest of their spans, and all spans."""
    found = find_secrets(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = listed(F.filter("secrets", lambda s: s["kind"] != "model"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(F.encode(base, "utf-8"), 256).alias("base_sha256"), listed("secrets").alias("spans"), count("model"))
