"""Secret scan: fixed patterns, and a randomness test battery with false-discovery control.

Runs of key-like characters are tested against the uniform source of the encoding they
seem to use: chi-squared over the alphabet, runs about the median, lag-1 serial
correlation, and the share of digits.  How far ordinary writing passes these tests depends on the encoding and
the length, so the null distribution is measured per encoding and length class on all
letters of the corpus itself, with a smoothed tail below the resolution of its counts,
and the cut of each encoding and length class controls the false-discovery rate."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from math import log, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import stored, text_batches

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_LONG = re.compile(r"[0-9a-f]{24,}")
_NAMED = re.compile(r"[^=]+(?:=+$)?")
#: Cuts of a run that no alphabet holds: base64 next to - or _, base64url next to / or +, keys among all of these.
_CUTS = (re.compile(r"[^_-]+"), re.compile(r"[^+/]+"), re.compile(r"[^/_-]+"))
#: Plain words glued to the ends of a piece.
_WORDS_BEFORE, _WORDS_AFTER = re.compile(r"(?:[A-Z]?[a-z]{3,}[+/_-]+)+"), re.compile(r"(?:[+/_-]+[A-Z]?[a-z]{3,})+$")
_SEPARATORS = re.compile(r"[+/_=-]+")
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Encodings from the smallest alphabet to the largest.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
ENCODINGS = tuple(ALPHABETS)
#: Length classes: (up to, length at which ordinary writing is measured).
LENGTHS = ((31, 24), (51, 40), (None, 64))
BINS = 40
#: Background strings that are tested at a time: their arrays stay in a core's cache.
BATCH = 4096
_SEP = b"/"
_OTHER = bytes(i for i in range(256) if not chr(i).isascii() or not chr(i).isalpha())
_TO_SEP = bytes(i if i not in _OTHER else _SEP[0] for i in range(256))
_CODE = {}
for _name, _alphabet in ALPHABETS.items():
    _CODE[_name] = np.full(128, -1, np.int16)
    _CODE[_name][[ord(c) for c in _alphabet]] = np.arange(len(_alphabet))
# Letters in the case that the encoding has; ordinary runs of hex are digits, so there letters stand for ten digits by their place in the alphabet.
_LOWER = np.array([ord(chr(i).lower()) for i in range(128)])
_LETTERS = {_name: (np.clip(_LOWER - 97, 0, 25) * 10 // 26 if _name == "hex" else _code[_LOWER - 32 if _name == "base32" else _LOWER if _name == "base36"
                    else np.arange(128)]).astype(np.int64) for _name, _code in _CODE.items()}
#: Which codes of an encoding are digits: ordinary words hold none of them, or (hex) nothing else.
DIGITS = {_name: np.array([c.isdigit() for c in _alphabet]) for _name, _alphabet in ALPHABETS.items()}
#: What stands between words in runs of an encoding: paths and slugs are ordinary writing too.
BETWEEN = {"base64": "/", "base64url": "_"}
#: A tail of fewer background strings is smoothed.
RESOLVED = 30
#: Letters of English per 1,000, and the strings drawn from them that every background starts with, so that none is empty.
FREQUENT = {"e": 127, "t": 91, "a": 82, "o": 75, "i": 70, "n": 67, "s": 63, "h": 61, "r": 60, "d": 43, "l": 40, "c": 28, "u": 28, "m": 24, "w": 24,
            "f": 22, "g": 20, "y": 20, "p": 19, "b": 15, "v": 10, "k": 8, "j": 2, "x": 2, "q": 1, "z": 1}
#: Words per 1,000 letters.
WORDS = 215
REFERENCE = 2000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    # Matches of the short pattern are the maximal runs, so the long ones can be found directly.
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(out)


def infer_encoding(run: str) -> str | None:
    """The smallest alphabet that holds all characters but trailing ``=``; upper-case hex counts as hex."""
    core = run.rstrip("=")
    chars = set(core)
    for name in ENCODINGS:
        if chars <= set(ALPHABETS[name]):
            return name
    return "hex" if chars <= set("0123456789ABCDEF") else None


def _normal_tail(z: np.ndarray) -> np.ndarray:
    """P(N > z), by a rational approximation of the error function (absolute error below 2e-7)."""
    x = np.abs(z) / sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    erfc = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-x * x)
    return np.where(z >= 0, erfc / 2, 1 - erfc / 2)


@lru_cache(maxsize=1 << 12)
def _digit_logs(length: int, share: float) -> np.ndarray:
    """Logarithm of the two-sided p-value of k digits among ``length`` letters, by k, at that share of digits."""
    k = np.arange(length + 1)
    fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, length + 1)))])
    p = np.exp(fact[-1] - fact - fact[::-1] + k * log(share) + (length - k) * log(1 - share))
    return np.log(np.clip(2 * np.minimum(p.cumsum(), p[::-1].cumsum()[::-1]), 1e-12, 1))


def _groups(size: int, length: int) -> np.ndarray:
    """The chi-squared group of each code."""
    n = int(min(size, max(2, length // 5)))
    return (np.arange(size) * n // size).astype(np.uint8)


def _battery(codes: np.ndarray, group: np.ndarray, above: np.ndarray, digit: np.ndarray | None, size: int, share: float = 0.0) -> np.ndarray:
    """Combined p-value of each column: one string by letter position, as codes, groups, upper halves and digits (bytes).
    Positions come first, so that every step runs along the strings."""
    length, n = codes.shape
    shares = np.bincount(_groups(size, length)) / size
    chi, rest = np.full(n, -float(length)), np.full(n, float(length))
    for g, part in enumerate(shares[:-1]):
        count = (group == g).sum(0, dtype=np.uint8 if length < 256 else np.int64).astype(np.float64)
        chi += count * count / (length * part)
        rest -= count
    chi += rest * rest / (length * shares[-1])
    df = len(shares) - 1
    p_chi = _normal_tail((np.cbrt(np.maximum(chi, 0) / df) - 1 + 2 / (9 * df)) / sqrt(2 / (9 * df)))  # Wilson-Hilferty
    kind = np.uint8 if length < 256 else np.int64
    up = above.sum(0, dtype=kind).astype(np.float64)
    runs = 1.0 + (above[1:] != above[:-1]).sum(0, dtype=kind)
    mean = 2 * up * (length - up) / length + 1
    var = np.maximum(1e-9, (mean - 1) * (mean - 2) / (length - 1))
    p_runs = np.where((up == 0) | (up == length), 1e-12, 2 * _normal_tail(np.abs(runs - mean) / np.sqrt(var)))
    c = codes.astype(np.float32 if length < 256 else np.float64)  # sums of products of codes: whole numbers that these hold
    s = c.sum(0).astype(np.float64)
    m = s / length
    spread = np.maximum(1e-9, (c * c).sum(0) - s * m)
    lag = (c[1:] * c[:-1]).sum(0) - m * (2 * s - c[0] - c[-1]) + (length - 1) * m * m
    p_lag = 2 * _normal_tail(np.abs(lag / spread) * sqrt(length - 1))
    # Fisher's combination: chi-squared of twice as many degrees of freedom as tests.
    half = -(np.log(np.maximum(p_chi, 1e-12)) + np.log(np.maximum(p_runs, 1e-12)) + np.log(np.maximum(p_lag, 1e-12)))
    if digit is None:
        return np.exp(-half) * (1 + half + half * half / 2)
    half -= _digit_logs(length, share)[digit.sum(0, dtype=kind)]
    return np.exp(-half) * (1 + half * (1 + half / 2 * (1 + half / 3)))


def randomness(codes: np.ndarray, size: int, digits: np.ndarray | None = None) -> np.ndarray:
    """Combined p-value (rows: strings of one length, as letter numbers below ``size``) under the uniform source: chi-squared
    over the alphabet, runs about the median, serial correlation, and the share of ``digits`` (a mask of the codes)."""
    across = np.ascontiguousarray(codes.T)
    group, above = _groups(size, len(across))[across], (across >= size // 2).astype(np.uint8)
    return _battery(across, group, above, None if digits is None else digits.astype(np.uint8)[across], size, 0.0 if digits is None else float(digits.mean()))


@lru_cache(maxsize=None)
def _byte_tables(name: str, length: int) -> tuple[bytes, ...]:
    """Code, group, upper half and digit of every byte of ordinary writing in an encoding."""
    code = np.zeros(256, np.int64)
    code[:128] = np.maximum(_LETTERS[name], 0)
    if name in BETWEEN:
        code[_SEP[0]] = _LETTERS[name][ord(BETWEEN[name])]
    size = len(ALPHABETS[name])
    return tuple(t.astype(np.uint8).tobytes() for t in (code, _groups(size, length)[code], code >= size // 2, DIGITS[name][code]))


def length_class(n: int) -> int:
    return next(i for i, (top, _) in enumerate(LENGTHS) if top is None or n <= top)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for the least random, BINS - 1 for p near 1; four bins per factor of ten."""
    return np.clip(BINS - 1 + np.floor(4 * np.log10(np.maximum(p, 1e-300))), 0, BINS - 1).astype(np.int64)


def _is_hypothesis(core: str) -> bool:
    """Runs of one character, or of separators without a letter or digit, are no possible keys."""
    return len(set(core)) > 1 and not _SEPARATORS.fullmatch(core)


def parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested in a run: its pieces between ``=`` (padding at the end stays), and where
    no alphabet holds a piece, the pieces of each cut of at least 20 characters, less plain words at their ends; those may overlap."""
    out = []
    for m in _NAMED.finditer(run):
        core = m[0].rstrip("=")
        if len(core) < 20:
            continue
        if infer_encoding(core):
            out.append((m.start(), m.end()))
            continue
        for cut in _CUTS:
            for x in cut.finditer(core):
                at = x.start() + (w.end() if (w := _WORDS_BEFORE.match(x[0])) else 0)
                to = x.start() + (w.start() if (w := _WORDS_AFTER.search(x[0])) else len(x[0]))
                if to - at >= 20 and infer_encoding(core[at:to]):
                    out.append((m.start() + at, m.end() if to == len(core) else m.start() + to))
    return sorted(set(out))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, cell, bin) of every part of at least 20 characters of the key-like runs; cell: encoding and length class."""
    out = []
    for m in _RUN.finditer(text):
        for at, to in parts(m[0]):
            core = m[0][at:to].rstrip("=")
            if not _is_hypothesis(core):
                continue
            name = infer_encoding(core)
            codes = _CODE[name][np.frombuffer((core.lower() if name == "hex" else core).encode(), np.uint8)][None, :].astype(np.int64)
            b = int(_bin(randomness(codes, len(ALPHABETS[name]), DIGITS[name]))[0])
            out.append((m.start() + at, m.start() + to, ENCODINGS.index(name) * len(LENGTHS) + length_class(len(core)), b))
    return out


def _collapsed(t: bytes) -> bytes:
    """Letters, with one separator for all that stands between them."""
    a = np.frombuffer(t.translate(_TO_SEP), np.uint8)
    sep = a == _SEP[0]
    return a[~(sep & np.concatenate([[True], sep[:-1]]))].tobytes().rstrip(_SEP) if len(a) else b""


def background(texts: list[str]) -> np.ndarray:
    """Counts (cell, bin) of ordinary writing: all letters of every text, with a separator between words where the encoding has
    one, cut into strings of each class."""
    hist = np.zeros((len(ENCODINGS) * len(LENGTHS), BINS), np.int64)
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    for parted, letters in ((False, [t.translate(None, _OTHER) for t in raw]), (True, [_collapsed(t) for t in raw])):
        for i, (_, n) in enumerate(LENGTHS):
            strings = np.frombuffer(b"".join(s[:len(s) // n * n] for s in letters), np.uint8).reshape(-1, n)
            for at in range(0, len(strings), BATCH):
                across = strings[at:at + BATCH].T
                shape, flat = across.shape, across.tobytes()
                for e, name in enumerate(ENCODINGS):
                    if (name in BETWEEN) == parted:
                        tables = [np.frombuffer(flat.translate(t), np.uint8).reshape(shape) for t in _byte_tables(name, n)]
                        b = _bin(_battery(*tables, len(ALPHABETS[name]), float(DIGITS[name].mean())))
                        hist[e * len(LENGTHS) + i] += np.bincount(b, minlength=BINS)
    return hist


def reference() -> np.ndarray:
    """Counts (cell, bin) of REFERENCE strings per cell of independent letters in the frequencies of English (fixed seed)."""
    rng = np.random.default_rng(0)
    hist = np.zeros((len(ENCODINGS) * len(LENGTHS), BINS), np.int64)
    for e, name in enumerate(ENCODINGS):
        often = FREQUENT | ({BETWEEN[name]: WORDS} if name in BETWEEN else {})
        codes, share = _LETTERS[name][[ord(c) for c in often]], np.array([*often.values()], float)
        for i, (_, n) in enumerate(LENGTHS):
            b = _bin(randomness(codes[rng.choice(len(codes), (REFERENCE, n), p=share / share.sum())], len(ALPHABETS[name]), DIGITS[name]))
            hist[e * len(LENGTHS) + i] = np.bincount(b, minlength=BINS)
    return hist


def tail(counts: np.ndarray) -> np.ndarray:
    """P(bin >= b) of ordinary strings of one cell.

    Where fewer than RESOLVED strings lie in the tail, it goes on with the factor per bin at which the last
    resolved factor of ten fell (the tail itself falls faster), and never below the counted share.  If it
    does not fall that far before, all else is in fewer than RESOLVED strings, and goes on like the p-value itself."""
    least = counts[::-1].cumsum()[::-1]
    p = least / max(1, least[0])
    last = int(np.flatnonzero(least >= min(RESOLVED, least[0]))[-1])
    beyond = np.maximum(np.arange(BINS) - last, 0)
    upper = np.flatnonzero(least[:last] >= 10 * least[last])
    if len(upper):
        smooth = p[last] * (p[last] / p[upper[-1]]) ** (beyond / (last - upper[-1]))
    else:
        smooth = min(1.0, RESOLVED / max(1, least[0])) * 10 ** (-(beyond - 1) / 4)
    return np.where(beyond > 0, np.maximum(p, smooth), p)


def p_values(ordinary: np.ndarray) -> np.ndarray:
    """(cell, bin): share of ordinary strings of the cell that look at least as random."""
    return np.array([tail(counts) for counts in ordinary + reference()])


def cuts(found: np.ndarray, ordinary: np.ndarray, rate: float) -> list[int]:
    """Per cell the smallest bin that counts as random (BINS: none).

    The p-value of a candidate is the share of ordinary strings of its cell that look at
    least as random; the Benjamini-Hochberg step over the candidates of the cell sets the limit."""
    out = []
    for mine, p in zip(found, p_values(ordinary)):
        rank = mine[::-1].cumsum()[::-1]
        good = (p <= rate * rank / max(1, mine.sum())) & (rank > 0)
        out.append(int(np.flatnonzero(good)[0]) if good.any() else BINS)
    return out


def overlapping(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Per candidate (by start) whether it shares characters with another one."""
    out, reach = [], 0
    for i, (start, end, *_) in enumerate(found):
        out.append(start < reach or (i + 1 < len(found) and found[i + 1][0] < end))
        reach = max(reach, end)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.001) -> DataFrame:
    """One row per input row: id_col, base (array of kind:start:end), found (all spans: array of struct start, kind, end).

    Whole texts are scanned once; spans and candidates go to the shared folder.  Two
    tables of encoding x length class x bin counts, of fixed size, give the cuts; a native filter applies
    them.  ``rate`` bounds the expected share of ordinary strings among the random spans of each encoding and length class.

    NULL text counts as empty (no spans); offsets are code points, end exclusive.  Repeated rows and NULL ids are scanned like others.
    An empty table gives no rows; other columns are not read."""
    text_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span_type, cand_type = "array<struct<start:long,kind:int,end:long>>", "array<struct<start:long,end:long,cell:int,bin:int,shared:boolean>>"

    def run(batches):
        for b in batches:
            texts = list(b["text"])
            cands = [candidates(t) for t in texts]
            hist = background(texts).ravel()
            at = np.flatnonzero(hist)
            yield pd.DataFrame({
                id_col: b["id"], "base": [[{"start": s, "kind": k, "end": e} for s, k, e in base_spans(t)] for t in texts],
                "cand": [[{"start": s, "end": e, "cell": c, "bin": x, "shared": o} for (s, e, c, x), o in zip(found, overlapping(found))] for found in cands],
                "seen": [{int(i): int(hist[i]) for i in at}] + [None] * (len(texts) - 1)})

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = stored(rows.mapInPandas(run, f"`{id_col}` {kind}, base {span_type}, cand {cand_type}, seen map<int,long>"), "spans")
    shape = (len(ENCODINGS) * len(LENGTHS), BINS)
    ordinary, found = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    for r in rows.select(F.explode("seen").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        ordinary[divmod(r["i"], BINS)] = r["n"]
    for r in rows.select(F.explode("cand").alias("c")).groupBy("c.cell", "c.bin").agg(F.count(F.lit(1)).alias("n")).collect():
        found[r["cell"], r["bin"]] = r["n"]
    least = F.array(*[F.lit(c) for c in cuts(found, ordinary, rate)])
    rows = rows.withColumn("hit", F.filter("cand", lambda c: c["bin"] >= F.get(least, c["cell"])))
    # Of overlapping cuts of one run those with the smaller p-value (then the longer ones) are listed.
    p = p_values(ordinary)
    level = F.array(*[F.lit(int(x)) for x in np.unique(p, return_inverse=True)[1].ravel()])
    ranked = F.array_sort(F.transform(F.filter("hit", lambda c: c["shared"]), lambda c: F.struct(
        F.get(level, c["cell"] * BINS + c["bin"]).alias("level"), (c["start"] - c["end"]).alias("short"), c["start"].alias("start"), c["end"].alias("end"))))
    rows = rows.withColumn("ranked", ranked)
    chosen = """aggregate(ranked, cast(array() as array<struct<start:bigint,kind:int,end:bigint>>), (acc, c) ->
        if(exists(acc, d -> d.start < c.end and c.start < d.end), acc, array_append(acc, named_struct('start', c.start, 'kind', 3, 'end', c.end))))"""
    random = F.concat(F.expr("transform(filter(hit, c -> not c.shared), c -> named_struct('start', c.start, 'kind', 3, 'end', c.end))"), F.expr(chosen))
    return rows.select(id_col, "base", F.sort_array(F.concat("base", random)).alias("found"))


def spans_text(spans):
    """kind:start:end, comma-joined, by start and then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def sha256_of(spans: list[tuple[int, int, int]]) -> str:
    """The digest column of one row, in plain Python (for tests)."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
