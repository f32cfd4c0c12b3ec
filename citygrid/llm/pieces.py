"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, best score first and leftmost
first among equals, and merges until no adjacent pair is in the vocabulary; symbols
that are no piece fall back to bytes.

A text is first cut where no piece of the vocabulary reaches across: before a run
of space marks, and between letters, digits and other characters. That no piece
reaches across is checked for every piece when the model is loaded; the few pieces
that do are kept in a list, and a word that holds one of them, with its space marks, is
not cut any further. So a text is the chain of its words' encodings, and each word is
encoded once per worker as long as the memo holds it. New words of many texts are merged
side by side: a row of a numpy matrix is a word's agenda, and each step merges the best
pair of every row. These words need no cuts; long ones, those that need bytes and those
that may hold a piece of the list are cut and go on alone. All texts of an Arrow batch
are also encoded whole by the sentencepiece library; a difference stops the job.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import heapq
import re
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from citygrid.llm.common import GenerationalCache

SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]*")
FINE = re.compile(rf"{SPACE}*[^\W\d_]+|{SPACE}+[^\w{SPACE}]*|[^\w{SPACE}]+|.", re.DOTALL)
#: Up to so many symbols the agenda is a plain list of scores, beyond it a heap.
SHORT = 32
NEVER = float("-inf")
BARE = "\0"  # before a word that has no space mark before it
LONG = 64  # longer words and cuttings are not kept
ROWS = 2048  # words that are merged side by side
CHARS = 1_000_000  # texts whose words are looked up together


class Codec:
    """Encoder and decoder over one model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        sp = self.library
        size = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece goes on past a space mark: words cannot be encoded one by one")
        self.crossing = [p for p in self.ids if FINE.match(p).end() < len(p)]
        # characters of which every crossing piece has one: most texts have none of them
        self.signs, left = "", self.crossing
        while left:
            self.signs += max({c for p in left for c in p}, key=lambda c: (sum(c in p for p in left), c))
            left = [p for p in left if self.signs[-1] not in p]
        self.sign, self.plain = re.compile(f"[{re.escape(self.signs)}]" if self.signs else r"(?!)"), re.compile(rf"{SPACE}[^\W\d_]+")
        if not all(sp.is_byte(i) for i in self.bytes) or any("\n" in p for p in self.ids):
            raise ValueError("the model has no byte pieces, or pieces with line feeds")
        # ids of one small table, so that cached encodings share their objects
        self.number, self.text = list(range(size)), [str(i) for i in range(size)]
        self.numbers = np.array(self.number, object)
        self._pairs(size)
        self.new: list[tuple[str, tuple[int, ...]]] = []
        self.cache = GenerationalCache(self._cutting, 150_000, LONG)
        self.words = GenerationalCache(None, 500_000, LONG)

    def _pairs(self, size: int) -> None:
        """Pieces by the two symbols that they are merged from, as numbers: pieces, then characters that are
        none but stand in one, then ``dead``, which is merged with nothing."""
        number = self.ids | {c: size + k for k, c in enumerate(sorted({c for p in self.ids for c in p} - self.ids.keys()))}
        self.dead = dead = size + len(number) - len(self.ids)
        self.char = np.full(0x110000, dead, np.int32)
        for symbol, i in number.items():
            if len(symbol) == 1:
                self.char[ord(symbol)] = i
        made = {number[p[:k]] * (dead + 1) + number[p[k:]]: i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        made[dead * (dead + 1) + dead] = -1  # no pair is beyond this one
        self.pair = np.array(sorted(made), np.int32 if (dead + 1) ** 2 < 2**31 else np.int64)
        self.piece = np.array([made[k] for k in sorted(made)], np.int32)
        self.rank = np.full(size + 1, NEVER, np.float32)  # the last one is that of no piece
        self.rank[list(self.ids.values())] = list(self.score.values())

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each two symbols, or -1."""
        pair = left.astype(self.pair.dtype) * (self.dead + 1) + right
        at = self.pair.searchsorted(pair)
        return np.where(self.pair[at] == pair, self.piece[at], -1)

    def merge_all(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of non-empty words; those that need bytes are left out."""
        ordered, out = sorted(words, key=len), {}
        for at in range(0, len(ordered), ROWS):
            self._merge_rows(ordered[at : at + ROWS], out)
        return out

    def _merge_rows(self, words: list[str], out: dict[str, tuple[int, ...]]) -> None:
        """One agenda a row, all in step. Two columns more than the longest word has: what follows it, what is before it."""
        lengths = np.array([len(w) for w in words])
        n, width = len(words), int(lengths.max()) + 2
        live = np.arange(width) < lengths[:, None]
        symbol = np.full((n, width), self.dead, np.int32)
        symbol[live] = self.char[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        piece = np.full((n, width), -1, np.int32)
        piece[:, :-1] = self._merged(symbol[:, :-1], symbol[:, 1:])
        agenda = self.rank[piece]
        follows = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        before[:, 0] = width - 1
        start, kept = np.arange(n) * width, live.ravel()
        s, m, a, f, b = (x.ravel() for x in (symbol, piece, agenda, follows, before))
        while True:
            i = agenda.argmax(1) + start  # the leftmost of equals
            i = i[a[i] > NEVER]
            if not i.size:
                break
            row = i // width * width
            j = row + f[i]
            after, prior = row + f[j], row + b[i]
            s[i], a[j], kept[j] = m[i], NEVER, False
            f[i], b[after] = f[j], i - row
            m[i], m[prior] = self._merged(s[i], s[after]), self._merged(s[prior], s[i])
            a[i], a[prior] = self.rank[m[i]], self.rank[m[prior]]
        left = symbol[live]
        ids = self.numbers[np.minimum(left, len(self.number) - 1)].tolist()
        whole = ((symbol < len(self.number)) | ~live).all(1).tolist()
        at = 0
        for word, end, well in zip(words, accumulate(live.sum(1).tolist()), whole):
            if well:
                out[word] = tuple(ids[at:end])
            at = end

    def merge(self, word: str) -> list[str]:
        """The symbols of ``word`` when no adjacent pair can be merged any more."""
        if len(word) > SHORT:
            return self._merge_long(word)
        symbols, score = list(word), self.score
        agenda = [score.get(word[i : i + 2], NEVER) for i in range(len(word) - 1)]
        while agenda and (best := max(agenda)) > NEVER:
            i = agenda.index(best)  # the leftmost of equals
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i < len(agenda):
                agenda[i] = score.get(symbols[i] + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = score.get(symbols[i - 1] + symbols[i], NEVER)
        return symbols

    def _merge_long(self, word: str) -> list[str]:
        symbols: list[str | None] = list(word)
        n, score = len(symbols), self.score
        agenda = []
        for i in range(n - 1):
            s = score.get(word[i : i + 2])
            if s is not None:
                agenda.append((-s, i, 2))
        if not agenda:
            return symbols
        heapq.heapify(agenda)
        follows, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while agenda:
            _, i, length = heapq.heappop(agenda)
            left = symbols[i]
            if left is None or (j := follows[i]) >= n or len(left) + len(symbols[j]) != length:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = left + symbols[j], None
            after = follows[i] = follows[j]
            if after < n:
                before[after] = i
                pair = symbols[i] + symbols[after]
                if (s := score.get(pair)) is not None:
                    heapq.heappush(agenda, (-s, i, len(pair)))
            if (b := before[i]) >= 0:
                pair = symbols[b] + symbols[i]
                if (s := score.get(pair)) is not None:
                    heapq.heappush(agenda, (-s, b, len(pair)))
        return [s for s in symbols if s is not None]

    def _cutting(self, cutting: str) -> tuple[int, ...]:
        ids, number = [], self.number
        for s in self.merge(cutting):
            i = self.ids.get(s)
            if i is None:
                ids.extend([number[self.bytes[b]] for b in s.encode()])
            else:
                ids.append(number[i])
        self.new.append((cutting, value := tuple(ids)))
        return value

    def _alone(self, marked: str) -> tuple[int, ...]:
        crossed = self.sign.search(marked) and any(p in marked for p in self.crossing)
        cuttings = [marked] if crossed or self.plain.fullmatch(marked) else FINE.findall(marked)
        return tuple(chain.from_iterable([self.cache[c] for c in cuttings]))

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        bare = text.replace(" ", SPACE)
        if bare[0] == SPACE or SPACE * 2 in bare or BARE in bare:
            return [w for w in WORD.findall(SPACE + bare) if w]
        # no piece has a line feed: what is between two is encoded for itself
        return bare.replace("\n", f"{SPACE}\n{SPACE}{BARE}").split(SPACE)

    def _learn(self, words: set[str]) -> dict[str, tuple[int, ...]]:
        """What the memo is to hold of words that it has not, or not any more, among the young. A word has its space
        marks, or stands for one mark and itself, or after ``BARE`` for itself alone."""
        old, values, marks = self.words.old, {}, {}
        for word in words:
            if (value := old.get(word)) is None:
                marks[word] = word if word[:1] == SPACE else word[1:] if word[:1] == BARE else word if word == "\n" else SPACE + word
            else:
                values[word] = value
        sign = self.sign.search
        merged = self.merge_all({m for m in marks.values() if 0 < len(m) <= SHORT and not sign(m)})
        self.new += merged.items()
        for word, marked in marks.items():
            values[word] = merged.get(marked) or self._alone(marked)
        self.words.hold(values)
        return values

    def _encode(self, texts: list[str]) -> list[tuple[list[int], str]]:
        split = [self._split(t) for t in texts]
        found = [list(map(self.words.get, words)) for words in split]
        holes = [[i for i, f in enumerate(of) if f is None] if None in of else [] for of in found]
        values = self._learn({words[i] for words, at in zip(split, holes) for i in at})
        for words, of, at in zip(split, found, holes):
            for i in at:
                of[i] = values[words[i]]
        text, ids = self.text, [list(chain.from_iterable(of)) for of in found]
        return [(of, ",".join([text[i] for i in of])) for of in ids]

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """-> of each text its ids, and the decimal ids joined by commas."""
        out, at, collects = [], 0, gc.isenabled()
        gc.disable()  # nothing here refers to itself, and the memo is large to go through
        try:
            while at < len(texts):
                end, chars = at + 1, len(texts[at])
                while end < len(texts) and chars + len(texts[end]) <= CHARS:
                    chars += len(texts[end])
                    end += 1
                out += self._encode(texts[at:end])
                at = end
        finally:
            if collects:
                gc.enable()
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        return self.encode_all([text])[0]

    def check_new(self) -> None:
        """Hold the cuttings met since the last call against the library.

        They are encoded as lines of one text: no piece joins a line feed to anything.
        """
        new, self.new = self.new, []
        if not new:
            return
        line = self.bytes[10]
        own = [self.ids[SPACE], line]
        for _, ids in new:
            own += ids
            own.append(line)
        text = "\n".join(["", *(w for w, _ in new), ""])
        if self.library.encode(text.replace(SPACE, " ")) != own:
            for word, ids in new:
                theirs = self.library.encode("\n" + word)[2:]
                if theirs != list(ids):
                    raise ValueError(f"{word!r}: {ids} here, {theirs} from the library")
            raise ValueError("the library's ids of a batch differ")

    def check(self, texts: list[str], encoded: list[list[int]]) -> None:
        """Hold whole texts against the library, so that cuts are checked too."""
        theirs = self.library.encode(texts, num_threads=1)
        if theirs != encoded:
            self.check_new()
            text = next(t for t, a, b in zip(texts, encoded, theirs) if a != b)
            raise ValueError(f"{text[:200]!r}: the library's ids of the text differ, not those of its cuttings")
        self.new.clear()

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1)


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """-> id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids and decoded.

    Null and empty texts have no tokens and decode to the empty text; long ones are
    encoded whole. Every row gives a row, repeated and null ids included, an empty table
    none; other columns are ignored. ``model`` is a path that
    executors can open (None: the installed public one); it is read once per worker.
    """
    extra = [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] if keep_ids else []
    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep_ids else "")

    def run(batches):
        c = codec(model or default_model())
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = [t or "" for t in texts.slice(at, 256).to_pylist()]
                encoded = c.encode_all(part)
                c.check(part, [e[0] for e in encoded])
                decoded = [c.decode(e[0]) if e[0] else "" for e in encoded]
                out = [
                    batch.column(0).slice(at, 256),
                    pa.array([len(e[0]) for e in encoded], pa.int64()),
                    pa.array([hashlib.sha256(e[1].encode()).hexdigest() for e in encoded]),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
                ]
                if keep_ids:
                    out += [pa.array([e[0] for e in encoded], extra[0].type), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(out, [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(f.name for f in extra)])

    from pyspark.sql import functions as F

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)
