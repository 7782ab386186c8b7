"""BPE as a streaming transducer with bounded lookahead, and its incremental decoder.

Encoding. The merge list bounds how far to the right a later symbol can change
an earlier token: a merge can only be prevented by an earlier merge that takes
its right symbol, so the longest chain of such merges, measured in symbols, is a
sufficient lookahead. Every word passes the transducer: it holds the symbols behind
the last emitted token, and emits a token once the lookahead lies behind it, so its
memory does not grow with the word.

Tokens are found by compatibility: a token may follow another exactly if merging the
two strings together leaves the two tokens, which only their facing edges decide;
and a sequence of tokens is the encoding if all its neighbours are compatible.

Texts are read out of the Arrow buffer in windows, and ids are appended to the
output's buffer window by window; neither a text nor its ids ever are one Python
object. A window ends at white space; a run without any is cut where a word must
end, and only a single word longer than a window makes it longer. Pieces between
white space recur, so a bounded memo maps a piece to its ids. The decoder reads
and writes buffers in the same way.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drift_atlas.llm import textkit

#: Bytes of a text, and ids, taken at a time; a word may be longer.
WINDOW = 1 << 16
#: Pieces that the memo of a Python worker holds, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 200_000, 64
#: Pairs of tokens of which a worker remembers whether they fit.
KNOWN_PAIRS = 250_000
#: Bytes of an output batch; a value may be longer.
BATCH_BYTES = 8 << 20

#: A rank behind all ranks.
_NEVER = 1 << 60

_CONTROL = regex.compile("[\x1c-\x1f]")
#: Where a word ends whatever follows, and no character combines with the one before: behind a letter, or before a number.
_WORD_END = regex.compile(r"(?<=\p{L})(?=[^\p{L}\p{N}\p{M}\s])|(?<=\S)(?=\p{N})")
_SPACES = re.compile(rb"[ \t-\r]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


LETTERS = _byte_letters()


class Merges:
    """A vocabulary and its merge list, from the JSON of a tokenizer file."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.names = {i: t for t, i in (self.vocab | self.special).items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for k, (a, b) in enumerate(pairs):
            self.rank.setdefault((self.vocab[a], self.vocab[b]), (k, self.vocab[a + b]))
        self.pattern = regex.compile(self._pattern(data["pre_tokenizer"]))
        self.special_pattern = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.longest = max(map(self.symbols_in, self.vocab))
        self.lookahead = self._sufficient_lookahead(pairs)
        self._splits: dict[int, tuple[int, ...] | None] = {}
        self.edges = _Edges(self)
        self._known: dict[int, bool] = {}

    @staticmethod
    def _pattern(pre: dict) -> str:
        for step in pre.get("pretokenizers", [pre]):
            if step["type"] == "Split":
                return step["pattern"]["Regex"]
        raise ValueError("the tokenizer file has no split pattern")

    def symbols_in(self, token: str) -> int:
        return len(token) - (len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0)

    def _sufficient_lookahead(self, pairs: list[list[str]]) -> int:
        """Symbols of the longest chain of merges, each of which an earlier one can prevent."""
        reach: dict[str, int] = {}
        for a, b in pairs:  # in the order of their ranks
            span = self.symbols_in(a) + max(self.symbols_in(b), reach.get(b, 0))
            reach[a] = max(reach.get(a, 0), span)
        return max(reach.values(), default=1)

    def symbols(self, word: str, last: bool = True) -> list[int]:
        """Ids of the initial symbols of a byte-level word."""
        ids = [self.vocab[c] for c in word]
        if last and ids and self.suffix:
            ids[-1] = self.vocab[word[-1] + self.suffix]
        return ids

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a sequence of symbols, lowest rank first, leftmost first."""
        if len(ids) < 2:
            return ids
        if len(ids) <= 24:
            ids = list(ids)
            while True:
                best = None
                for k in range(len(ids) - 1):
                    r = self.rank.get((ids[k], ids[k + 1]))
                    if r is not None and (best is None or r[0] < best[0]):
                        best = (r[0], k, r[1])
                if best is None:
                    return ids
                ids[best[1] : best[1] + 2] = [best[2]]
        ids = list(ids)
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r[0], k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := self.rank.get((ids[k], ids[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            n = after[k]
            if ids[k] != a or n >= len(ids) or ids[n] != b:
                continue
            ids[k], ids[n] = self.rank[a, b][1], -1
            after[k] = after[n]
            if after[k] < len(ids):
                before[after[k]] = k
            for left in (before[k], k):
                if left >= 0 and after[left] < len(ids) and (r := self.rank.get((ids[left], ids[after[left]]))):
                    heapq.heappush(heap, (r[0], left, ids[left], ids[after[left]]))
        return [i for i in ids if i >= 0]

    def _initial(self, token: int) -> list[int]:
        name = self.names[token]
        ends = bool(self.suffix) and name.endswith(self.suffix)
        return self.symbols(name[: len(name) - len(self.suffix)] if ends else name, ends)

    def whole(self, token: int) -> bool:
        """Whether merging a token's own symbols gives that token."""
        return self.edges[token] is not None

    def edges_of(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]] | None:
        """What stands at a token's left and at its right edge while it is merged: (piece, rank of the merge that ends it); None if it isn't whole."""
        if self._last_merge(token) is None:
            return None
        edges = []
        for side in (0, 1):
            found: list[tuple[int, int]] = []
            at, until = token, _NEVER
            while True:
                found.append((at, until))
                parts = self._last_merge(at)
                if not parts:
                    break
                at, until = parts[side], self.rank[parts][0]
            edges.append(found[::-1])
        return edges[0], edges[1]

    def _last_merge(self, token: int) -> tuple[int, ...] | None:
        """The two tokens whose merge ends in this one, () for an initial symbol, None if its symbols merge to something else."""
        if token not in self._splits:
            ids = self._initial(token)
            last: tuple[int, ...] = ()
            while len(ids) > 1:
                ranked = [(r[0], k) for k in range(len(ids) - 1) if (r := self.rank.get((ids[k], ids[k + 1])))]
                if not ranked:
                    break
                k = min(ranked)[1]
                last = (ids[k], ids[k + 1])
                ids[k : k + 2] = [self.rank[last][1]]
            self._splits[token] = last if ids == [token] else None
        return self._splits[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether merging two whole tokens' symbols together leaves the two tokens.

        Only their facing edges matter. The edges are followed merge by merge, the left
        one first where both wait for the same merge; a merge across them that comes
        before the next merge of either edge breaks the tokens.
        """
        known = self._known.get(key := left << 32 | right)
        if known is None:
            if len(self._known) >= KNOWN_PAIRS:
                self._known.clear()
            known = self._known[key] = self._fits(self.edges[left][1], self.edges[right][0])
        return known

    def _fits(self, a: list[tuple[int, int]], b: list[tuple[int, int]]) -> bool:
        rank = self.rank
        i = j = 0
        (x, ends_x), (y, ends_y) = a[0], b[0]
        while True:
            across = rank.get((x, y))
            if across is not None and across[0] < ends_x and across[0] <= ends_y:
                return False
            if ends_x <= ends_y:
                if ends_x == _NEVER:
                    return True
                i += 1
                x, ends_x = a[i]
            else:
                j += 1
                y, ends_y = b[j]


class _Edges(dict):
    """Tokens' edges, found when they are first asked for."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, token: int):
        self[token] = self.merges.edges_of(token)
        return self[token]


class WordTransducer:
    """Symbols of one word in, stable tokens out.

    It holds the symbols behind the last emitted token. Whenever these are ``check_every``
    more than the lookahead, they are encoded as they stand, and the tokens that end at
    least the lookahead before their end are emitted.
    """

    def __init__(self, merges: Merges, check_every: int = 64):
        self.merges, self.check_every = merges, check_every
        self.text = ""  # symbols since the last emitted token
        self.before: int | None = None  # the last emitted token

    def feed(self, letters: str) -> list[int]:
        """Take further byte-level letters of the word; return the tokens that have become stable."""
        room = self.merges.lookahead + self.check_every
        if len(self.text) + len(letters) <= room:
            self.text += letters
            return []
        out: list[int] = []
        for k in range(0, len(letters), self.check_every):
            self.text += letters[k : k + self.check_every]
            if len(self.text) > room:
                out += self._stable()
        return out

    def close(self) -> list[int]:
        """End the word; return what is left."""
        return [token for token, _ in self._path(self.text, self.merges.suffix)]

    def _path(self, text: str, suffix: str) -> list[tuple[int, int]]:
        """The encoding behind the last emitted token: (token, its end).

        Of the tokens that may follow the longest is tried first. A prefix has one
        encoding only, so an end from which no token leads on is on no encoding.
        """
        m, prior = self.merges, self.before
        token_of, edges_of, fits, longest, size = m.vocab.get, m.edges, m.fits, m.longest, len(text)
        out: list[tuple[int, int]] = []
        closed: set[int] = set()
        at, end = 0, min(longest, size)
        while at < size:
            while end > at:
                token = token_of(text[at:] + suffix if end == size else text[at:end])
                if token is not None and edges_of[token] is not None and (prior is None or fits(prior, token)) and end not in closed:
                    out.append((token, end))
                    prior, at, end = token, end, min(end + longest, size)
                    break
                end -= 1
            else:
                if not out:
                    raise ValueError("the merge list does not encode every text")
                closed.add(at)
                end = out.pop()[1] - 1
                prior, at = out[-1] if out else (self.before, 0)
        return out

    def _stable(self) -> list[int]:
        """Emit the tokens that nothing behind the lookahead can change; the newest symbol may be the word's last and is left out."""
        known = self.text[:-1]
        out = [(token, end) for token, end in self._path(known, "") if end <= len(known) - self.merges.lookahead]
        if out:
            self.before, cut = out[-1]
            self.text = self.text[cut:]
        return [token for token, _ in out]


class Encoder:
    """Texts to ids, as the tokenizer file prescribes: special tokens, NFC, white space, lower case, split, merges."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.memo = _Memo(self)

    def word(self, word: str) -> list[int]:
        transducer = WordTransducer(self.merges)
        out: list[int] = []
        for k in range(0, len(word), WINDOW):
            part = word[k : k + WINDOW]
            plain = part.isascii() and part.isprintable()  # such letters stand for themselves
            out += transducer.feed(part if plain else "".join([LETTERS[b] for b in part.encode()]))
        return out + transducer.close()

    def piece(self, piece: str) -> bytes:
        """Packed ids of a piece. A word split off a piece is a piece that splits no further."""
        words = [piece] if piece.isalpha() else self.merges.pattern.findall(piece)
        if len(words) == 1:
            return array("I", self.word(words[0])).tobytes()
        memo = self.memo
        return b"".join([memo[w] for w in words])

    @staticmethod
    def windows(view: memoryview) -> Iterator[str]:
        """Stretches of UTF-8 that end where a word ends."""
        at, size = 0, len(view)
        while at < size:
            end = min(at + WINDOW, size)
            if end < size:
                found = _SPACES.search(view, end, end + WINDOW)
                if found is None:
                    end = Encoder._word_end(view, at, end)
                else:
                    end = found.start()
            yield str(view[at:end], "utf-8")
            at = end

    @staticmethod
    def _word_end(view: memoryview, at: int, end: int) -> int:
        """The last end of a word in a window without white space behind it; the window grows until it holds one."""
        while True:
            while end < len(view) and view[end] & 0xC0 == 0x80:
                end += 1
            if end >= len(view):
                return len(view)
            part = str(view[at:end], "utf-8")
            cut = max((m.start() for m in _WORD_END.finditer(part)), default=0)
            cut = max(cut, *(part.rfind(c) for c in " \t\n\x0b\x0c\r"))
            if cut > 0:
                return at + len(part[:cut].encode())
            end = min(end + 8 * WINDOW, len(view))

    def feed(self, view: memoryview) -> Iterator[bytes]:
        """UTF-8 in, ids as little-endian unsigned 32-bit integers out, window by window; special tokens are stretches of their own."""
        at = 0
        if self.merges.special_pattern is not None:
            for match in self.merges.special_pattern.finditer(view):
                yield from self._plain(view[at : match.start()])
                yield np.array([self.merges.special[str(match[0], "utf-8")]], "<u4").tobytes()
                at = match.end()
        yield from self._plain(view[at:])

    def _plain(self, view: memoryview) -> Iterator[bytes]:
        for part in self.windows(view):
            if not part.isascii():
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            pieces = regex.split(r"\s+", part) if _CONTROL.search(part) else part.split()
            memo = self.memo
            yield b"".join([memo[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """The packed ids of one text."""
        return b"".join(self.feed(memoryview((text or "").encode())))


class _Memo(dict):
    """Packed ids of pieces; emptied when full."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = self.encoder.piece(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:
                self.clear()
            self[piece] = packed
        return packed


class Decoder:
    """Ids in, text out, chunk by chunk.

    ``joined`` gives what a tokenizer file without a decoder prescribes: the
    tokens' names with one space between. ``text`` turns byte letters into bytes and
    those into characters, holding back the bytes of an unfinished character, and
    word ends into spaces.
    """

    def __init__(self, merges: Merges, form: str = "joined"):
        if form not in ("joined", "text"):
            raise ValueError(f"form must be joined or text, not {form!r}")
        self.form, self.names = form, merges.names
        self.started = False
        if form == "text":
            byte = {c: b for b, c in enumerate(LETTERS)}
            special = set(merges.special.values())
            self.bytes = {}
            for i, name in merges.names.items():
                ends = bool(merges.suffix) and name.endswith(merges.suffix) and i not in special
                body = name[: len(name) - len(merges.suffix)] if ends else name
                self.bytes[i] = body.encode() if i in special else bytes(byte[c] for c in body) + b" " * ends
            self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        if self.form == "text":
            return self.utf8.decode(b"".join([self.bytes[i] for i in ids]))
        names = self.names
        out = " ".join([names[i] for i in ids])
        if out and self.started:
            out = " " + out
        self.started = self.started or bool(out)
        return out

    def close(self) -> str:
        return self.utf8.decode(b"", True) if self.form == "text" else ""


_loaded: dict[str, Encoder] = {}


def _encoder(spec: str) -> Encoder:
    """One encoder, and its memo, for each Python worker and tokenizer."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = Encoder(Merges(spec))
    return _loaded[spec]


def _views(column: pa.Array) -> Iterator[memoryview]:
    """The bytes of each value of a string or binary column, null as none, without a copy."""
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    raw, at = textkit.buffers(column, large)
    data = memoryview(raw)
    for k in range(len(column)):
        yield data[at[k] : at[k + 1]]


def _appended(batch: pa.RecordBatch, convert, kind: pa.DataType) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, rows, values) of the second column converted, in arrays of bounded size that grow part by part."""
    out, ends, first = bytearray(), [0], 0
    for k, view in enumerate(_views(batch.column(1))):
        for part in convert(view):
            out += part
        ends.append(len(out))
        if len(out) >= BATCH_BYTES or k == batch.num_rows - 1:
            made = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(np.array(ends, np.int64)), pa.py_buffer(out)])
            yield first, len(ends) - 1, made
            out, ends, first = bytearray(), [0], k + 1


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of every whole text, as little-endian unsigned 32-bit integers.

    ``vocabulary`` is the path of a tokenizer file, read by the driver and sent
    out once (its size is that of the vocabulary). Null counts as empty and gives
    no ids. Every row is encoded alone, so order and repeats do not matter;
    further columns are dropped. Columns: the id, ``ids`` binary.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            for first, n, ids in _appended(batch, encoder.feed, pa.large_binary()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), ids.cast(pa.binary())], names=[batch.schema.names[0], "ids"])

    rows = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", form: str = "joined") -> DataFrame:
    """The text of every sequence of ids, null as none. Columns: the id, ``ids``, ``decoded``."""
    spec = encoded.sparkSession.sparkContext.broadcast(read_spec(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _encoder(spec.value).merges

        def text(view: memoryview) -> Iterator[bytes]:
            decoder = Decoder(merges, form)
            for k in range(0, len(view), 4 * WINDOW):
                yield decoder.feed(np.frombuffer(view[k : k + 4 * WINDOW], "<u4").tolist()).encode()
            yield decoder.close().encode()

        for batch in batches:
            for first, n, texts in _appended(batch, text, pa.large_string()):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), batch.column(1).slice(first, n), texts.cast(pa.string())], names=[id_col, "ids", "decoded"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary, decoded string")
