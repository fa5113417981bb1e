"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on a small labelled table (`labelled_table`, or the user's own with columns sentence, position,
token, tag). Tokens without a digit or "@" are bound to the tag O, so that a text falls into short independent chains
between them; Viterbi over these is exact, and runs over many chains at once in numpy, whose memory CELLS bounds.

Defined results: null is as empty text, without spans; spans count code points, end exclusive; a pattern's spans stay,
and a span of the field that overlaps one is dropped; repeated rows get equal results; kept columns pass through.
"""

import random
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from . import _spark, _text

KINDS = ("email", "ip", "card", "phone")
TAGS = ("O", *(f"{side}-{kind}" for kind in KINDS for side in "BI"))
#: Rows of the labelled table at most; steps and rate of training; weight of the squared weights.
TABLE, STEPS, RATE, RIDGE = 20_000, 120, 0.2, 0.02
#: Tokens that are decoded at once at most, and characters of a shape.
CELLS, LONGEST_SHAPE = 16_384, 64

_AFTER_AT = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")  # never goes back: a sign is a digit or not
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if i % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def _emails(text: str):
    """Each match has one "@", so its start is found backwards from there: linear, whatever the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AFTER_AT.match(text, at + 1) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _ips(text: str):
    """Four runs of digits joined by single dots, leftmost first; parts over 255 drop a match."""
    for m in _DOTTED.finditer(text):
        whole, at = m.group(), m.start()
        if whole.count(".") < 3:
            continue
        parts = [(p.start(), p.end()) for p in re.finditer(r"[0-9]+", whole)]
        i = 0
        while i + 3 < len(parts):
            if all(parts[i + k + 1][0] - parts[i + k][1] == 1 for k in range(3)):
                if all(len(x := whole[a:b].lstrip("0")) < 4 and int(x or 0) <= 255 for a, b in parts[i : i + 4]):
                    yield at + parts[i][0], at + parts[i + 3][1]
                i += 4
            else:
                i += 1


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)] + [(1, a, b) for a, b in _ips(text)]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def core(token: str) -> tuple[int, int]:
    """The token without what surrounds it: from, to."""
    a, b = 0, len(token)
    while b > a and not (token[b - 1].isalnum() or token[b - 1] == ")"):
        b -= 1
    while a < b and not (token[a].isalnum() or token[a] in "+("):
        a += 1
    return a, b


def shape(word: str) -> str:
    """Digits as d and their number, letters as x, other signs as they are; ~ if that is longer than any shape in use."""
    out = re.sub(r"[0-9]+", lambda m: f"d{min(len(m.group()), 20)}", re.sub(r"[^\W0-9_]+", "x", word))
    return out if len(out) <= LONGEST_SHAPE else "~"


def signs(words: list[str]) -> list[tuple]:
    """All that the features of each token of one chain say: shapes (before, own, after), number of digits, whether it could be a card, an address, a mail."""
    shapes = ["<", *(shape(w) for w in words), ">"]
    out = []
    for i, w in enumerate(words):
        digits = re.sub(r"[^0-9]", "", w)
        card = 13 <= len(digits) <= 19 and re.fullmatch(r"[0-9-]+", w) is not None and luhn(digits)
        ip = re.fullmatch(r"([0-9]{1,3}\.){3}[0-9]{1,3}", w) is not None and all(int(p) < 256 for p in w.split("."))
        out.append((*shapes[i : i + 3], min(len(digits), 20), card, ip, "@" in w))
    return out


def named(sign: tuple) -> list[str]:
    """The features of a token with these signs."""
    before, own, after, digits, card, ip, at = sign
    rough = [re.sub(r"d[0-9]+", "d", s) for s in (before, own, after)]
    out = [f"s{own}", f"c{rough[1]}", f"p{rough[0]}", f"n{rough[2]}", f"d{digits}", f"P{before}|{rough[1]}", f"N{rough[1]}|{after}"]
    return out + [name for name, on in (("card", card), ("ip", ip), ("@", at)) if on]


def features(words: list[str]) -> list[list[str]]:
    return [named(sign) for sign in signs(words)]


def chains(tokens: list[str]) -> list[list[int]]:
    """Runs of tokens with a digit or "@"."""
    out, last = [], -2
    for i, t in enumerate(tokens):
        if "@" in t or re.search(r"[0-9]", t):
            if last != i - 1:
                out.append([])
            out[-1].append(i)
            last = i
    return out


class Chain:
    """Neighbouring tokens of one text, kept as their places, so that a very long chain takes 16 bytes a token."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, array("q"), array("q")

    def add(self, start: int, end: int) -> None:
        self.start.append(start)
        self.end.append(end)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, part: slice) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[part], self.end[part], strict=True)]


@dataclass
class Field:
    index: dict[str, int]
    state: np.ndarray  # features x tags
    move: np.ndarray  # tag x next tag
    start: np.ndarray

    def emissions(self, chain, first: int = 0, last: int | None = None) -> np.ndarray:
        """Of the tokens first to last (all): their neighbours on both sides are looked at too."""
        last = len(chain) if last is None else last
        a = max(first - 1, 0)
        near = signs(chain[a : last + 1])[first - a : last - a]
        kinds = {sign: k for k, sign in enumerate(dict.fromkeys(near))}  # many tokens are alike
        rows = [self.state[[self.index[f] for f in named(sign) if f in self.index]].sum(0) for sign in kinds]
        return np.array(rows).reshape(-1, len(TAGS))[[kinds[sign] for sign in near]]

    def decode(self, many: list) -> list[list[int] | np.ndarray]:
        """The best tags of each chain (list of tokens, or Chain): Viterbi, a step for all chains of a batch at once.

        A batch has CELLS tokens at most, the padding of its shorter chains included; a longer chain is a batch of
        its own and its emissions come in parts, so that one byte a token and tag is all that it takes.
        """
        sizes = np.array([len(c) for c in many], np.int64)
        order = np.argsort(-sizes, kind="stable")
        out: list = [[] for _ in many]
        a = 0
        while a < len(order):
            rows = order[a : a + max(1, CELLS // max(int(sizes[order[a]]), 1))]
            a += len(rows)
            size = sizes[rows]
            longest = int(size[0])
            if not longest:
                break
            back = np.zeros((len(rows), longest, len(TAGS)), np.int8)
            best = np.zeros((len(rows), len(TAGS)))
            for t in range(longest):
                if t % CELLS == 0:
                    e = np.zeros((len(rows), min(CELLS, longest - t), len(TAGS)))
                    for i, r in enumerate(rows):
                        if size[i] > t:
                            part = self.emissions(many[r], t, min(t + CELLS, int(size[i])))
                            e[i, : len(part)] = part
                if t == 0:
                    best = e[:, 0] + self.start
                    continue
                m = int((size > t).sum())  # chains are by length: the first ones
                step = best[:m, :, None] + self.move
                back[:m, t] = step.argmax(1)
                best[:m] = step.max(1) + e[:m, t % CELLS]
            for i, r in enumerate(rows):
                tags = np.zeros(size[i], np.int8)
                tags[-1] = tag = int(best[i].argmax())
                for t in range(int(size[i]) - 1, 0, -1):
                    tags[t - 1] = tag = int(back[i, t, tag])
                out[r] = tags if len(rows) == 1 else tags.tolist()
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit(table: DataFrame) -> Field:
    """Conditional maximum likelihood by Adam on the labelled table (TABLE rows at most)."""
    rows = table.select("sentence", "position", "token", "tag").orderBy("sentence", "position").limit(TABLE).collect()
    by: dict = {}
    for r in rows:
        by.setdefault(r["sentence"], []).append((r["token"] or "", r["tag"] or "O"))
    words, tags = [], []
    for sentence in by.values():
        for c in chains([t for t, _ in sentence]):
            words.append([(t := sentence[i][0])[slice(*core(t))] for i in c])
            tags.append([TAGS.index(sentence[i][1]) for i in c])
    k, index = len(TAGS), {}
    feats = [features(w) for w in words]
    for chain in feats:
        for fs in chain:
            for f in fs:
                index.setdefault(f, len(index))
    size = np.array([len(w) for w in words], int)
    n, longest = len(words), int(size.max(initial=1))
    at, seq = [], []
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, chain in enumerate(feats):
        y[i, : size[i]], mask[i, : size[i]] = tags[i], True
        for t, fs in enumerate(chain):
            at += [index[f] for f in fs]
            seq += [i * longest + t] * len(fs)
    at, seq, eye = np.array(at, int), np.array(seq, int), np.eye(k)
    params = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = eye[y] * mask[:, :, None]
    gold_move = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for step in range(1, STEPS + 1 if n else 1):
        state, move, start = params
        e = np.zeros((n * longest, k))
        np.add.at(e, seq, state[at])
        e = e.reshape(n, longest, k)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + start
        for t in range(1, longest):
            alpha[:, t] = np.where(mask[:, t, None], _log_sum(alpha[:, t - 1, :, None] + move, 1) + e[:, t], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            beta[:, t] = np.where(mask[:, t + 1, None], _log_sum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _log_sum(alpha[:, -1], 1)[:, None, None]
        p = np.exp(alpha + beta - z) * mask[:, :, None]
        pair = np.exp(np.minimum(alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[..., None], 0)) * mask[:, 1:, None, None]
        wrong = (p - gold).reshape(n * longest, k)
        g_state = np.zeros_like(state)
        np.add.at(g_state, at, wrong[seq])
        grads = [g_state, pair.sum((0, 1)) - gold_move, (p[:, 0] - gold[:, 0]).sum(0)]
        for j, g in enumerate(grads):
            g = g + RIDGE * params[j]
            first[j], second[j] = 0.9 * first[j] + 0.1 * g, 0.99 * second[j] + 0.01 * g * g
            params[j] = params[j] - RATE * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    return Field(index, *params)


def labelled_table(spark: SparkSession, sentences: int = 400, seed: int = 11) -> DataFrame:
    """A small labelled table by rule: filler words and plain numbers, with personal data in common forms between them."""
    r = random.Random(seed)
    d = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    word = lambda: "".join(r.choice("abdeghilmnorstu") for _ in range(r.randint(2, 9)))

    def card(ok: bool) -> str:
        n = r.choice((14, 15, 16, 16, 16, 19))
        x = d(n - 1)
        check = next(c for c in "0123456789" if luhn(x + c))
        return x + (check if ok else str((int(check) + r.randint(1, 9)) % 10))

    def data(kind: str) -> list[str]:
        if kind == "email":
            return [f"{word()}{r.choice(('.', '_', ''))}{d(r.randint(0, 2)) or word()}@{word()}{r.choice(('', d(1)))}.{word()}.{r.choice(('com', 'org', 'net'))}"]
        if kind == "ip":
            return [".".join(str(r.randrange(256)) for _ in range(4))]
        if kind == "card":
            x = card(True)
            return [x] if r.random() < 0.7 else (["-".join(re.findall(".{1,4}", x))] if r.random() < 0.5 else re.findall(".{1,4}", x) if len(x) == 16 and luhn(x) else [x])
        body = r.choice(([f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"], [f"({d(3)})", d(3), d(4)]))
        return ([f"+{d(r.randint(1, 2))}"] if r.random() < 0.6 else []) + body

    plain = (
        lambda: [d(r.randint(1, 12))], lambda: [f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}"], lambda: [f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"],
        lambda: [card(False)], lambda: [d(20), d(3)], lambda: ["".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40))))], lambda: [f"{d(1)}.{d(1)}.{d(1)}"], lambda: [f"{d(3)}.{d(2)}"],
        lambda: [f"{word()}{d(2)}"], lambda: [f"{d(3)}.{d(3)}.{d(3)}.{int(d(1)) + 256}"], lambda: [d(3), d(4)], lambda: [f"({r.randint(1900, 2030)})"], lambda: [d(4), d(4)], lambda: ["@"], lambda: [f"@{word()}"], lambda: [f"{d(1)}-{d(1)}"],
    )
    rows = []
    for s in range(sentences):
        tokens: list[tuple[str, str]] = []
        for _ in range(r.randint(2, 5)):
            tokens += [(word(), "O") for _ in range(r.choice((0, 1, 2, 3)))]
            if r.random() < 0.5:
                kind = r.choice(KINDS)
                tokens += [(t, f"{'BI'[i > 0]}-{kind}") for i, t in enumerate(data(kind))]
            else:
                tokens += [(t, "O") for t in r.choice(plain)()] + [(word(), "O")]
        rows += [(s, i, t + r.choice(("", "", "", ",", ".", "%%%", "***")), tag) for i, (t, tag) in enumerate(tokens)]
    return spark.createDataFrame(rows, "sentence int, position int, token string, tag string")


def _apart(spans: list[tuple[int, int, int]], others: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of spans (kind, start, end) that overlap none of others."""
    if not spans or not others:
        return spans
    start = np.sort([a for _, a, _ in others])
    reach = np.maximum.accumulate([b for _, _, b in sorted(others, key=lambda s: s[1])])
    before = np.searchsorted(start, [b for _, _, b in spans])  # others that begin before the span ends
    return [s for s, k in zip(spans, before.tolist(), strict=True) if not k or reach[k - 1] <= s[1]]


def spans_of(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(kind, start, end, whether a pattern found it) for each text, by kind and start."""
    many, place = [], []
    base = [patterns(t) for t in texts]
    for i, text in enumerate(texts):
        last, chain = None, None
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            w = m.group()
            if "@" in w or not w.isalpha() and re.search(r"[0-9]", w):
                a, b = core(w)
                if last != m.start():
                    many.append(chain := Chain(text))
                    place.append(i)
                chain.add(m.start() + a, m.start() + b)
                last = m.end() + 1
    out = []
    added: dict[int, list] = {}
    for i, chain, tags in zip(place, many, field.decode(many), strict=True):
        open_ = None
        for k in (*np.flatnonzero(tags).tolist(), len(tags)):  # most tokens are of no kind
            tag = tags[k] if k < len(tags) else 0
            if open_ and not (tag and tag % 2 == 0 and (tag - 1) // 2 == open_[0] and k == open_[3] + 1):
                added.setdefault(i, []).append(tuple(open_[:3]))
                open_ = None
            if tag:
                kind, a, b = int(tag - 1) // 2, chain.start[k], chain.end[k]
                open_ = [open_[0], open_[1], b, k] if open_ else [kind, a, b, k]
    for i, own in enumerate(base):
        more = _apart([s for s in added.get(i, ()) if s[2] > s[1]], own)
        out.append(sorted([(*s, True) for s in own] + [(*s, False) for s in more]))
    return out


def _parts(batches):
    """Slices of batches, with the rows whose text has a digit or "@" (only these can have spans)."""
    signal = np.zeros(256, bool)
    signal[48:58] = signal[64] = True
    for batch in batches:
        for part in _text.slices(batch, 0):
            data, off = _text.buffer(part.column(0))
            hits = np.concatenate([[0], np.cumsum(signal[data])])
            yield part, np.flatnonzero(hits[off[1:]] > hits[off[:-1]])


def find(docs: DataFrame, field: Field, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns keep, then spans: array of (kind, start, end, base), by kind as in KINDS, then start."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for part, rows in _parts(batches):
            out: list = [[]] * part.num_rows
            for r, spans in zip(rows, spans_of(part.column(0).take(pa.array(rows)).to_pylist(), shared.value), strict=True):
                out[r] = [{"kind": KINDS[k], "start": a, "end": b, "base": base} for k, a, b, base in spans]
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(out, kind)], names=[*keep, "spans"])

    return docs.select(F.col(text_col).cast("string").alias("_text"), *keep).mapInArrow(run, _spark.kept(docs, keep, "spans array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"))


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """docs with each span of the text replaced by <KIND>; spans that overlap become one. Null stays null."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def run(batches):
        for part, rows in _parts(batches):
            texts = part.column(0).to_pylist()
            for r, spans in zip(rows, spans_of([texts[r] for r in rows], shared.value), strict=True):
                pieces, at, text = [], 0, texts[r]
                for a, b, k in sorted((a, -b, k) for k, a, b, _ in spans):
                    if a >= at:
                        pieces += [text[at:a], f"<{KINDS[k].upper()}>"]
                    at = max(at, -b)
                texts[r] = "".join([*pieces, text[at:]])
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *part.columns[1:]], names=order)

    order = [text_col, *(c for c in names if c != text_col)]
    return docs.select(order).mapInArrow(run, StructType([docs.schema[c] for c in order])).select(names)
