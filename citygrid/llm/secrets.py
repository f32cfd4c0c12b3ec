"""Secret scans: a linear-chain conditional random field beside three base patterns.

Words between white space are tagged begin, inside or outside; unbroken text of several
fields (JSON, query strings) is cut at quotes, commas, signs and braces first, and each
part is a word. Features are a word's
shape, the kinds of the words next to it and what the file looks like. The field is
fitted by numpy gradient ascent on the likelihood (forward-backward) over windows of
a bounded sample of documents, half of which get invented secrets planted with a fixed
seed; what the base patterns find in a window counts as secret too.

Decoding is exact Viterbi. Most words are outside by so wide a margin that no best
path can tag them otherwise: a word whose outside score leads by more than all that
its two transitions can differ by. Those words cut a document into short runs, and
only the runs are decoded step by step.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citygrid.llm.common import GenerationalCache, min_rounds

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more is the same match as the whole run
KINDS = ("assign", "access", "hex", "tagged")
STEMS = ("passw", "secret", "token", "api", "ſ", "K")
WORD = re.compile(r"[^\s]+")
HEXONLY = re.compile("[0-9a-f]+")
CORE = re.compile(r"[A-Za-z0-9+/_.=~$@!%^&*-]{8,}")


PART = re.compile(r"""[^"'`,;&?|<>(){}\[\]\\]+""")
FIELDS = 32  # words of up to so many characters hold no two secrets


def word_spans(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The places of a word's parts if it is long or two of them could be secrets, else its own."""
    if b - a <= FIELDS:
        return [(a, b)]
    parts = [m.span() for m in PART.finditer(text, a, b)]
    if len(parts) > 1 and (b - a > 400 or sum(y - x >= 12 for x, y in parts) > 1):
        return parts
    return [(a, b)]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns in code points, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(s in low for s in STEMS[:4]):  # every keyword has one of these
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


OUTSIDE, BEGIN, INSIDE = 0, 1, 2
OWN = 34  # own features
KEYWORD = re.compile(r"pass(word|wd|phrase)?|secret|token|api_?key|access|credential|auth|bearer|private|key|pwd", re.IGNORECASE)
NEAR = ("other", "keyword", "sign", "keyword and sign", "opening line", "edge")
FILES = 3


def near(word: str) -> int:
    """The kind of a word as a neighbour sees it."""
    if not word:
        return 5
    if "-----BEGIN" in word or word.endswith("KEY-----"):
        return 4
    sign, key = word[-1] in ":=" or word in ("->", "=>", ":="), KEYWORD.search(word) is not None
    return 3 if sign and key and len(word) > 1 else 2 if sign else 1 if key and len(word) < 24 else 0


PAIR = re.compile(r"[\"']?([A-Za-z_-]{2,24})[\"']?(?:=|:(?!/))(?=.)")
TRAIL = re.compile(r"[#$%&*!|]{2,}$")
DIGITS, LOWER, UPPER = re.compile("[0-9]+"), re.compile("[a-z]+"), re.compile("[A-Z]+")


def shape(word: str) -> list[int]:
    """The own features of a word that hold."""
    found = [0]
    letters = word.isalpha()
    if letters:
        found.append(30)
        core = word if word.isascii() else max(CORE.findall(word), key=len, default="")
    else:
        value = word
        if pair := PAIR.match(value):
            found.append(1)
            if KEYWORD.search(pair[1]):
                found.append(2)
            value = value[pair.end() :]
        core = max(CORE.findall(value), key=len, default="").strip(".,!%&*$#")
        if "@" in word or "://" in word or "www." in word:
            found.append(27)
        if "-----" in word:
            found.append(28)
        if word[0] in "\"'":
            found.append(29)
        if word.count(".") > 1 or word.count("-") > 2:
            found.append(32)
        if TRAIL.search(word):
            found.append(33)
    if not word.isascii():
        found.append(31)
    n = len(core)
    found.append(3 if n < 8 else 4 if n < 12 else 5 if n < 16 else 6 if n < 20 else 7 if n < 32 else 8 if n < 48 else 9)
    if n >= 8:
        runs = len(DIGITS.findall(core)), len(LOWER.findall(core)), len(UPPER.findall(core))
        digits = sum(map(len, DIGITS.findall(core))) if runs[0] else 0
        if digits:
            found.append(10)
            if runs[1] or runs[2]:
                found.append(11)
            if runs[1] and runs[2]:
                found.append(13)
            if digits + core.count("-") + core.count(".") + core.count("+") >= n - 1:
                found.append(14)  # a number
            if HEXONLY.fullmatch(core):
                found.append(15)
            if runs[2] and not runs[1]:
                found.append(16)
        if runs[1] and runs[2] and not core[1:].islower():
            found.append(12)
        found.append(17 + min(5, 10 * (sum(runs) - 1) // n))  # 17 to 22: how often the kind of character changes
        found.append(23 + min(2, 4 * len(set(core)) // min(n, 24) - 1) if n > 7 and 4 * len(set(core)) >= min(n, 24) else 23)  # 23 to 25: how many different ones
        if "_" in core[:8] or "-" in core[:5]:
            found.append(26)
    return found


def file_kind(text: str) -> int:
    signs = sum(text.count(c) for c in "={};")
    return 0 if signs * 400 < len(text) else 1 if signs * 60 < len(text) else 2


class Weights:
    """own (OWN x 3), before and after (kinds x 3), file (FILES x 3), moves (3 x 3)."""

    def __init__(self):
        self.own, self.before, self.after = np.zeros((OWN, 3)), np.zeros((len(NEAR), 3)), np.zeros((len(NEAR), 3))
        self.file, self.moves = np.zeros((FILES, 3)), np.zeros((3, 3))

    @property
    def swing(self) -> float:
        """More than two transitions into and out of a word can differ by."""
        return float(2 * (self.moves.max() - self.moves.min()) + 1e-6)


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """The best tags of a run that has outside words (or the text's edges) around it."""
    best, back = moves[OUTSIDE] + scores[0], []
    for s in scores[1:]:
        through = best[:, None] + moves
        back.append(through.argmax(0))
        best = through.max(0) + s
    tag = int((best + moves[:, OUTSIDE]).argmax())
    tags = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        tags.append(tag)
    return tags[::-1]


class Tagger:
    """A plain word has neighbours' kind 0 and, between plain words in any kind of file,
    an outside score that leads by more than the swing. So only words that are not
    plain, those next to them and the ends of a text need their scores worked out."""

    def __init__(self, w: Weights):
        self.w = w
        around = w.before[0] + w.after[0] + w.file
        self.around = [float(x) for x in (around[:, 1:] - around[:, :1]).max(0)]  # most that begin, inside gain on outside
        self.shapes: dict[tuple[int, ...], bool] = {}
        self.cache = GenerationalCache(self._plain, 250_000)

    def _plain(self, word: str) -> bool:
        found = tuple(shape(word))
        plain = self.shapes.get(found)
        if plain is None:  # there are a few hundred shapes
            own = self.w.own[list(found)].sum(0).tolist()
            plain = self.shapes[found] = all(own[OUTSIDE] - own[t] - self.around[t - 1] > self.w.swing for t in (BEGIN, INSIDE))
        return plain and near(word) == 0

    def scores(self, words: list[str], kind: int, at: list[int] | None = None) -> np.ndarray:
        """A row of tag scores for each word, or for those at the places ``at``."""
        w, n = self.w, len(words)
        rows = [w.own[shape(words[k])].sum(0) + w.before[near(words[k - 1]) if k else 5] + w.after[near(words[k + 1]) if k + 1 < n else 5] + w.file[kind] for k in (range(n) if at is None else at)]
        return np.array(rows)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        words = text.split()
        if not words:
            return []
        places = None
        if max(map(len, words)) > FIELDS:
            places = [p for m in WORD.finditer(text) for p in word_spans(text, *m.span())]
            words = [text[a:b] for a, b in places]
        plain = list(map(self.cache.__getitem__, words))
        plain[0] = plain[-1] = False
        odd, k = [], -1
        for _ in range(plain.count(False)):
            k = plain.index(False, k + 1)
            odd.append(k)
        look = sorted({x for k in odd for x in (k - 1, k, k + 1) if 0 <= x < len(words)})
        scores = self.scores(words, file_kind(text), look)
        close = scores[:, OUTSIDE] - scores[:, 1:].max(1) <= self.w.swing
        if not close.any():
            return []
        unsure, scores = np.array(look)[close], scores[close]
        out = []
        cuts = np.flatnonzero(np.diff(unsure) > 1) + 1
        for run, rows in zip(np.split(unsure, cuts), np.split(scores, cuts)):
            tags = viterbi(rows, self.w.moves)
            if not any(tags):
                continue
            places = places or [m.span() for m in WORD.finditer(text)]
            for k, tag in zip(run.tolist(), tags):
                if tag == OUTSIDE:
                    continue
                a, b = places[k]
                core = max(CORE.finditer(text, a, b), key=lambda m: len(m[0]), default=None)
                a, b = core.span() if core else (a, b)
                if "=" in text[a:b].rstrip("=") and text[a : a + 40].partition("=")[0].replace("_", "").replace("-", "").isalpha():
                    a += text[a:b].index("=") + 1
                while b > a and text[b - 1] in ".,!%&*$":
                    b -= 1
                if tag == INSIDE and out and out[-1][3] == k - 1 and text[places[k - 1][1] : places[k][0]].isspace():
                    out[-1] = (*out[-1][:2], b, k)
                elif b - a >= 8:
                    out.append(("tagged", a, b, k))
        return [s[:3] for s in out]

    def all_spans(self, text: str) -> tuple[list, list]:
        """-> base spans, and all spans: tagged ones are added where they meet no base span."""
        base = base_spans(text)
        more = [s for s in self.spans(text) if not any(s[1] < b and a < s[2] for _, a, b in base)]
        return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


WINDOW = 30


def invented(rng: np.random.Generator) -> list[str]:
    """The words of an invented secret with what stands around it; the secret's words begin with a NUL."""
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    value = [
        lambda: pick(low + up + num, rng.integers(16, 44)),
        lambda: pick(num + "abcdef", rng.choice([18, 24, 32, 40, 64])),
        lambda: "AKIA" + pick(up + num, 16),
        lambda: "ghp_" + pick(low + up + num, 36),
        lambda: "sk_live_" + pick(low + up + num, 24),
        lambda: "xoxb-" + pick(num, 11) + "-" + pick(low + up + num, 24),
        lambda: pick(low + up + num + "+/", 40) + "==",
        lambda: ".".join(["eyJ" + pick(low + up + num, 20), pick(low + up + num + "_-", 40), pick(low + up + num + "_-", 30)]),
    ][rng.integers(8)]()
    key = str(rng.choice("password passwd pwd secret token api_key apikey access_key auth_token client_secret private_key credential".split()))
    form = rng.integers(7)
    if form == 0:
        return [f"\0{key}={value}"]
    if form == 1:
        return [key, "=", f'\0"{value}"']
    if form == 2:
        return [f"{key}:", f"\0{value}"]
    if form == 3:
        return [f'\0"{key}":"{value}",']
    if form == 4:
        return ["Authorization:", "Bearer", f"\0{value}"]
    if form == 5:
        return ["\0-----BEGIN", "\0PRIVATE", "\0KEY-----", *["\0" + pick(low + up + num + "+/", 64) for _ in range(3)], "\0-----END", "\0PRIVATE", "\0KEY-----"]
    return [f"\0{value}"]


def harmless(rng: np.random.Generator) -> str:
    """An address, a link, a number or a version."""
    pick = lambda letters, n: "".join(rng.choice(list(letters), n))
    low, num = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    return [
        lambda: f"{pick(low, rng.integers(4, 10))}.{pick(num, 2)}@mail{pick(num, 1)}.example.com",
        lambda: f"{pick(low, 8)}@{pick(low, 7)}.org",
        lambda: f"https://www.{pick(low, 9)}.com/{pick(low, 4)}/{pick(num, 4)}/{pick(low, 6)}-{pick(low, 7)}.html",
        lambda: f"+{pick(num, 2)}-{pick(num, 3)}-{pick(num, 7)}",
        lambda: pick(num, 16),
        lambda: f"{pick(num, 4)}-{pick(num, 2)}-{pick(num, 2)}T{pick(num, 2)}:{pick(num, 2)}",
        lambda: f"{pick(low, 6).upper()}-{pick(low, 8)}",
    ][rng.integers(7)]()


def windows(texts: list[str], seed: int = 11, most: int = 4) -> list[tuple[list[str], list[int], int]]:
    """(words, tags, file kind) of up to ``most`` windows a text, with planted secrets in half."""
    rng = np.random.default_rng(seed)
    out = []
    for text in texts:
        places = [m.span() for m in WORD.finditer(text)]
        base = base_spans(text)
        starts = [max(0, k - WINDOW // 2) for k, (a, b) in enumerate(places) if any(x < b and a < y for _, x, y in base)][:1]
        starts += rng.integers(0, max(1, len(places) - WINDOW), most - len(starts)).tolist()
        kind = file_kind(text)
        for n, s in enumerate(starts):
            part = places[s : s + WINDOW]
            words, tags = [text[a:b] for a, b in part], [0] * len(part)
            hit = [any(x < b and a < y and not KEYWORD.fullmatch(text[a:b].strip("\"'")) and text[a:b] not in "=:" for _, x, y in base) for a, b in part]
            tags = [0 if not h else INSIDE if k and hit[k - 1] else BEGIN for k, h in enumerate(hit)]
            if n % 2 and words:
                new = invented(rng)
                at = int(rng.integers(0, len(words) + 1))
                marks = [w[:1] == "\0" for w in new]
                words[at:at] = [w.lstrip("\0") for w in new]
                tags[at:at] = [0 if not m else INSIDE if k and marks[k - 1] else BEGIN for k, m in enumerate(marks)]
            elif n % 4 == 2 and words:  # what looks like a secret and is none
                at = int(rng.integers(0, len(words) + 1))
                words.insert(at, harmless(rng))
                tags.insert(at, OUTSIDE)
                if at + 1 < len(tags) and tags[at + 1] == INSIDE:
                    tags[at + 1] = BEGIN
            if words:
                out.append((words[:WINDOW], tags[:WINDOW], kind))
    return out


def fit(data: list[tuple[list[str], list[int], int]], epochs: int = 60, rate: float = 0.5, keep: float = 1e-4) -> Weights:
    """Gradient ascent on the mean log-likelihood of all windows at once, with adaptive steps."""
    w = Weights()
    if not data:
        data = windows(["an ordinary line of words that says nothing of note " * 8] * 40)
    n, own_of = len(data), {}
    own = np.zeros((n, WINDOW, OWN), np.float32)
    kinds, tags, mask = np.full((n, WINDOW + 2), 5), np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), bool)
    files = np.array([k for _, _, k in data])
    for r, (words, t, _) in enumerate(data):
        for c, word in enumerate(words):
            f = own_of.setdefault(word, None) or shape(word)
            own_of[word] = f
            own[r, c, f] = 1
            kinds[r, c + 1] = near(word)
        tags[r, : len(t)], mask[r, : len(t)] = t, True
    before, after, file = np.eye(len(NEAR))[kinds[:, :-2]], np.eye(len(NEAR))[kinds[:, 2:]], np.eye(FILES)[files]
    gold = np.eye(3)[tags] * mask[..., None]
    path = np.concatenate([np.zeros((n, 1), np.int64), tags, np.zeros((n, 1), np.int64)], 1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (path[:, :-1], path[:, 1:]), 1)  # padding is outside, as the ends are
    norms = {k: np.full_like(getattr(w, k), 1e-8) for k in ("own", "before", "after", "file", "moves")}
    size = mask.sum()
    padding = np.where(mask[..., None], 0.0, np.array([0.0, -1e9, -1e9]))
    for _ in range(epochs):
        s = own @ w.own + before @ w.before + after @ w.after + (file @ w.file)[:, None]
        s = np.where(mask[..., None], s, padding)
        forward, backward = np.zeros((n, WINDOW, 3)), np.zeros((n, WINDOW, 3))
        add = lambda x, axis: np.log(np.exp(x - (m := x.max(axis, keepdims=True))).sum(axis)) + m.squeeze(axis)
        forward[:, 0] = w.moves[OUTSIDE] + s[:, 0]
        for t in range(1, WINDOW):
            forward[:, t] = add(forward[:, t - 1, :, None] + w.moves, 1) + s[:, t]
        backward[:, -1] = w.moves[:, OUTSIDE]
        for t in range(WINDOW - 2, -1, -1):
            backward[:, t] = add(w.moves + (s[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
        total = add(forward[:, -1] + w.moves[:, OUTSIDE], 1)
        p = np.exp(forward + backward - total[:, None, None])
        pairs = np.exp(forward[:, :-1, :, None] + w.moves + (s + backward)[:, 1:, None, :] - total[:, None, None, None]).sum((0, 1))
        pairs[OUTSIDE] += p[:, 0].sum(0)
        pairs[:, OUTSIDE] += p[:, -1].sum(0)
        miss = gold - p * mask[..., None]
        steps = {
            "own": np.einsum("ntf,ntk->fk", own, miss), "before": np.einsum("ntf,ntk->fk", before, miss), "after": np.einsum("ntf,ntk->fk", after, miss), "file": file.T @ miss.sum(1), "moves": gold_moves - pairs,
        }
        for k, g in steps.items():
            g = g / size - keep * getattr(w, k)
            norms[k] += g * g
            setattr(w, k, getattr(w, k) + rate * g / np.sqrt(norms[k]))
    return w


def train(docs: DataFrame, rows: int = 500, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Fit on windows of the ``rows`` documents whose id hashes least.

    The driver gets at most 4 windows of 30 words of each; a word is cut at 400
    characters there.
    """
    picked = min_rounds(docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("_id")).dropDuplicates(), "_id", rows)

    def run(batches):
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = windows([text or ""], seed=11 + i % 1_000_003)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(found)), pa.array([[x[:400] for x in f[0]] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found])], ["_id", "words", "tags", "kind"])

    chosen = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text")).join(F.broadcast(picked), "_id")  # at most ``rows`` ids
    found = chosen.mapInArrow(run, "_id long, words array<string>, tags array<long>, kind long").toPandas()
    found = sorted(zip(found["_id"], map(list, found["words"]), map(list, found["tags"]), found["kind"]), key=lambda x: (x[0], x[1]))
    return fit([(w, [int(t) for t in t_], int(k)) for _, w, t_, k in found])


def _mapped(batches, w, made):
    tagger = Tagger(w)
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield made(part, [tagger.all_spans(t or "") for t in part.column(part.num_columns - 1).to_pylist()])


def scan(docs: DataFrame, weights: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> id, n_assign, n_access, n_hex, base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, by start; ``tagged`` ones
    are those that the field adds. Null and empty texts have none, long ones are read
    whole. Every row gives a row, an empty table none; other columns are ignored. No shuffle.
    """

    def made(part, found):
        count = [Counter(k for k, _, _ in base) for base, _ in found]
        return pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array([c[k] for c in count], pa.int64()) for k in KINDS[:3]), pa.array([hashlib.sha256(join_spans(b).encode()).hexdigest() for b, _ in found], pa.string()), pa.array([join_spans(a) for _, a in found], pa.string())],
            [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    sent = docs.sparkSession.sparkContext.broadcast(weights)
    given = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return given.mapInArrow(lambda b: _mapped(b, sent.value, made), f"`{id_col}` long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, spans, mark: str = "[SECRET]") -> str | None:
    """``text`` with each run of overlapping spans written as ``mark``."""
    if not spans:
        return text
    parts, at = [], 0
    for _, a, b in spans:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, weights: Weights, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of ``docs`` with secrets in the text replaced; ``length_col`` follows the new text."""
    names = docs.columns

    def made(part, found):
        texts = [redacted(t, s, mark) for t, (_, s) in zip(part.column(part.num_columns - 1).to_pylist(), found)]
        columns = list(part.columns[:-1])
        columns[names.index(text_col)] = pa.array(texts, pa.string())
        if length_col in names:
            k = names.index(length_col)
            columns[k] = pa.array([len(t) if s else old for t, (_, s), old in zip(texts, found, columns[k].to_pylist())], columns[k].type)
        return pa.RecordBatch.from_arrays(columns, names)

    sent = docs.sparkSession.sparkContext.broadcast(weights)
    given = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").cast("string").alias("__text"))
    return given.mapInArrow(lambda b: _mapped(b, sent.value, made), docs.schema)
