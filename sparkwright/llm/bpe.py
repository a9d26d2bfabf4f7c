"""BPE encoding and decoding as streaming transducers.

The encoder reads a text in slices and holds one unfinished piece at a time.
Inside a piece, the merge list's *sufficient lookahead* L says how far a
symbol can act to the left: a change at some point moves left only by a merge
whose right part begins where the change now begins, and each such merge has a
later rank than the one before, so L is the longest such chain in symbols (a
dynamic program over the merges, from the last to the first). Tokens that end
L symbols before the end of what was read are stable and are emitted at once;
the rest starts anew at a token border, which BPE allows (Berglund and van der
Merwe, 2023). There memory is bounded by the window, whatever the text's length.

With a vocabulary of words (``by_words``) the text is split at once instead, and
words of up to ``LONG_WORD`` characters go by plain merging and are remembered;
only longer ones are streamed. Memory then follows the longest text.

The decoder is a state machine from ids to bytes to text: it keeps the bytes
of an unfinished character and emits text as soon as characters are whole."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import python_tasks

#: Characters of a word from which it is streamed rather than remembered.
LONG_WORD = 256
#: Characters normalised at once inside a long word.
SLICE = 4096
#: Words whose ids a task remembers before it starts afresh.
MEMORY = 250_000
#: Ids handed on at once.
BLOCK = 1 << 15


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is
    printable in Latin-1, else the next free one from 256 on."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = {b: chr(b) for b in keep}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


_CHAR_OF = _byte_alphabet()
_BYTE_OF = {c: b for b, c in enumerate(_CHAR_OF)}
_LATIN = {b: c for b, c in enumerate(_CHAR_OF)}
#: White space to str.split() that the patterns' \\s does not match.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")
#: Piece pattern of byte-level files that state none.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _younger() -> tuple[str, str, str]:
    """Character sets that name where the Unicode version of the vocabulary
    files' own pattern engine differs from this process's: characters unknown
    to ``unicodedata``; letters and numbers to ``regex`` that are none there."""
    every = [chr(i) for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000]
    unknown = [c for c in every if unicodedata.category(c) == "Cn"]
    sets = ["".join(unknown)]
    for kind in (r"\p{L}", r"\p{N}"):
        mine = "".join(regex.findall(kind, "".join(unknown)))
        found = pre_tokenizers.Split(Regex(kind), "removed", invert=True).pre_tokenize_str(mine)
        theirs = set("".join(t for t, _ in found))
        sets.append("".join(c for c in mine if c not in theirs))
    return tuple(_ranges(s) for s in sets)


def _ranges(chars: str) -> str:
    out, codes = [], sorted(map(ord, chars))
    for c in codes:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in out) + "]" if out else "[^\\s\\S]"


def _parts(spec: dict | None, key: str) -> list[dict]:
    if not spec:
        return []
    return spec[key] if spec["type"] == "Sequence" else [spec]


class Bpe:
    """A BPE vocabulary file (JSON) with a byte-level alphabet."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.pairs = pairs
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.token = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for t, i in [*self.vocab.items(), *special.items()]:
            self.token[i] = t
        self.names = list(map(str, range(len(self.token))))
        kinds = [p["type"] for p in _parts(spec.get("normalizer"), "normalizers")]
        self.nfc, self.lower = "NFC" in kinds, "Lowercase" in kinds
        split = [p for p in _parts(spec["pre_tokenizer"], "pretokenizers") if p["type"] == "Split"]
        #: The pieces hold no white space: words are independent of each other.
        self.by_words = bool(split)
        self.pattern = regex.compile(split[0]["pattern"]["Regex"] if split else _BYTE_LEVEL)
        unknown, letters, numbers = _younger()
        self.unknown = regex.compile(unknown)
        exact = self.pattern.pattern.replace(r"\p{L}", rf"[\p{{L}}--{letters}]").replace(r"\p{N}", rf"[\p{{N}}--{numbers}]")
        self.exact = regex.compile("(?V1)" + exact)
        chain = [normalizers.NFC()] * self.nfc + [normalizers.Lowercase()] * self.lower
        self.normalizer = normalizers.Sequence(chain)
        self.special_pattern = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.joined = spec.get("decoder") is None
        self._words: dict[str, tuple[int, ...]] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self.window = 0

    # ---- lookahead

    def lookahead(self) -> int:
        """Symbols after which nothing read later can change a token; 0 if the
        merge list does not allow a bound (a token with two rules)."""
        made = [a + b for a, b in self.pairs]
        if len(set(made)) < len(made):
            return 0
        size = lambda t: len(t.removesuffix(self.suffix)) if self.suffix else len(t)
        reach: dict[str, int] = {}  # by prefix of the right part, over later rules
        longest = 0
        for a, b in reversed(self.pairs):
            best = size(a) + reach.get(a, 0)
            longest = max(longest, best)
            for end in range(1, len(b) + 1):
                if reach.get(b[:end], 0) < best:
                    reach[b[:end]] = best
        return longest + 1

    # ---- one piece

    def merge(self, parts: list[str]) -> list[str]:
        """Tokens of a sequence of symbols: the merge of the smallest rank
        first, the leftmost of equal ones."""
        ranks = self.ranks
        if len(parts) <= 48:
            none, get = len(ranks), ranks.get
            held = [get(p, none) for p in zip(parts, parts[1:])]
            while held:
                best = min(held)
                if best == none:
                    break
                i = held.index(best)
                parts[i] += parts.pop(i + 1)
                del held[i]
                if i:
                    held[i - 1] = get((parts[i - 1], parts[i]), none)
                if i < len(held):
                    held[i] = get((parts[i], parts[i + 1]), none)
            return parts
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        alive: list[str | None] = list(parts)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if alive[i] != p[0] or j >= len(alive) or alive[j] != p[1]:
                continue
            alive[i], alive[j] = p[0] + p[1], None
            after[i] = after[j]
            if after[i] < len(alive):
                before[after[i]] = i
                q = (alive[i], alive[after[i]])
                if q in ranks:
                    heapq.heappush(heap, (ranks[q], i, q))
            if before[i] >= 0:
                q = (alive[before[i]], alive[i])
                if q in ranks:
                    heapq.heappush(heap, (ranks[q], before[i], q))
        return [t for t in alive if t is not None]

    def symbols(self, text: str) -> str:
        if text.isascii() and text.isprintable() and " " not in text:
            return text  # these bytes stand for themselves
        return text.encode().decode("latin-1").translate(_LATIN)

    def piece(self, text: str) -> tuple[int, ...]:
        got = self._pieces.get(text)
        if got is None:
            parts = list(self.symbols(text))
            parts[-1] += self.suffix
            got = tuple(map(self.vocab.__getitem__, self.merge(parts)))
            if len(self._pieces) >= MEMORY:
                self._pieces.clear()
            self._pieces[text] = got
        return got

    # ---- texts

    def normal(self, text: str) -> str:
        plain = text.isascii()
        if not plain and self._unknown(text):
            return self.normalizer.normalize_str(text)
        if self.nfc and not plain:
            text = unicodedata.normalize("NFC", text)
        if self.lower:  # letter by letter: no form of its own at a word's end
            text = text.lower() if plain else text.replace("Σ", "σ").lower()
        return text

    def _unknown(self, text: str) -> bool:
        """True if the text has characters younger than ``unicodedata``; all up
        to the first gap in the code table are known."""
        return max(text) >= "\u0378" and self.unknown.search(text) is not None

    def _pattern(self, text: str) -> regex.Pattern:
        return self.exact if not text.isascii() and self._unknown(text) else self.pattern

    def _word(self, word: str) -> tuple[int, ...]:
        text = self.normal(word)
        if text.isalpha() and max(text) < "\u0378":  # all letters: one piece
            return self.piece(text)
        out: list[int] = []
        for p in self._pattern(text).findall(text):
            out.extend(self.piece(p))
        return tuple(out)

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids in blocks; specials of the file count where their string stands."""
        if self.special_pattern is None or "<" not in text:
            yield from self._plain(text)
            return
        at = 0
        for m in self.special_pattern.finditer(text):
            if m.start() > at:
                yield from self._plain(text[at : m.start()])
            yield [self.special[m.group()]]
            at = m.end()
        if at < len(text):
            yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[list[int]]:
        if not self.by_words or _NOT_SPACE.search(text):
            yield from self._stream(self._slices(text))
            return
        out: list[int] = []
        memory = self._words
        for word in text.split():
            ids = memory.get(word)
            if ids is None:
                if len(word) > LONG_WORD:
                    yield out
                    out = []
                    yield from self._stream(self._slices(word))
                    continue
                if len(memory) >= MEMORY:
                    memory.clear()
                ids = memory[word] = self._word(word)
            out.extend(ids)
            if len(out) >= BLOCK:
                yield out
                out = []
        yield out

    def _slices(self, text: str) -> Iterator[str]:
        """Normalised slices, cut where normalising the parts is normalising
        the whole: before a character that joins nothing before it."""
        at = 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            while end < len(text) and not _starts_afresh(text[end]):
                end += 1
            yield self.normal(text[at:end])
            at = end

    def _stream(self, slices: Iterable[str]) -> Iterator[list[int]]:
        """Ids of the pieces of a text given in slices."""
        held, run = "", None
        for more in slices:
            if run is not None:  # inside a piece longer than a slice
                m = run.kind.match(more)
                yield run.push(self.symbols(m.group()))
                if m.end() == len(more):
                    continue
                yield run.finish()
                more, run = more[m.end() :], None
            held += more
            at, out = 0, []
            for m in self._pattern(held).finditer(held):
                if m.end() > len(held) - 3:  # more text may prolong it
                    break
                out.extend(self.piece(m.group()) if m.end() - m.start() <= LONG_WORD else self._long(m.group()))
                at = m.end()
            yield out
            held = held[at:]
            m = self._pattern(held).search(held)
            # (a run of white space is held whole: its last character may
            # belong to the next piece)
            if m and m.end() - m.start() > SLICE and not m.group().isspace():
                run = _Run(self, m.group())
                if m.end() < len(held):
                    yield run.push(self.symbols(m.group()))
                    yield run.finish()
                    held, run = held[m.end() :], None
                else:
                    yield run.push(self.symbols(m.group()))
                    held = ""
        if run is not None:
            yield run.finish()
        for m in self._pattern(held).finditer(held):
            yield list(self.piece(m.group()) if m.end() - m.start() <= LONG_WORD else self._long(m.group()))

    def _long(self, text: str) -> list[int]:
        run = _Run(self, text)
        return [*run.push(self.symbols(text)), *run.finish()]


class _Run:
    """One long piece: emits its stable tokens as its symbols come."""

    def __init__(self, bpe: Bpe, start: str):
        self.bpe, self.rest = bpe, ""
        body = start.lstrip(" ")[:1] or " "
        _, letters, numbers = _younger()
        letter, number = rf"[\p{{L}}--{letters}]", rf"[\p{{N}}--{numbers}]"
        for kind in (rf"{letter}*", rf"{number}*", rf"[^\s{letter}{number}]*", r"\s*"):
            self.kind = regex.compile("(?V1)" + kind)
            if self.kind.match(body).end():
                break
        if not bpe.window:
            bpe.window = bpe.lookahead() or -1

    def push(self, symbols: str) -> list[int]:
        self.rest += symbols
        reach = self.bpe.window
        out: list[int] = []
        if reach < 0:
            return out
        step = max(4 * reach, 1024)
        at = 0
        while len(self.rest) - at > step + reach:
            part = self.rest[at : at + step + reach]
            stable = 0
            for t in self.bpe.merge(list(part)):
                if stable + len(t) > step:
                    break
                stable += len(t)
                out.append(self.bpe.vocab[t])
            at += stable
        self.rest = self.rest[at:]
        return out

    def finish(self) -> list[int]:
        parts = list(self.rest)
        parts[-1] += self.bpe.suffix
        return [self.bpe.vocab[t] for t in self.bpe.merge(parts)]


def _starts_afresh(c: str) -> bool:
    """True if no normal form joins or reorders ``c`` with what precedes it."""
    if c < "̀":
        return True
    hangul_part = "ᅠ" <= c <= "ᇿ"
    return unicodedata.category(c)[0] in "LNPSZ" and not hangul_part and unicodedata.is_normalized("NFC", c)


class Decoder:
    """Text of a stream of ids. Byte-level files: the bytes of an unfinished
    character are kept until it is whole or broken (then U+FFFD, as one per
    maximal part). Files without a decoder: tokens joined by a space."""

    def __init__(self, bpe: Bpe):
        self.bpe, self.started = bpe, False
        self.chars = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        if self.bpe.joined:
            text = " ".join([self.bpe.token[i] for i in ids])
            text, self.started = " " + text if self.started else text, True
            return text
        return self.chars.decode(b"".join([_token_bytes(self.bpe.token[i]) for i in ids]))

    def finish(self) -> str:
        return "" if self.bpe.joined else self.chars.decode(b"", True)


@lru_cache(maxsize=1 << 17)
def _token_bytes(token: str) -> bytes:
    try:
        return bytes(_BYTE_OF[c] for c in token)
    except KeyError:
        return token.encode()


@lru_cache(maxsize=4)
def load(text: str) -> Bpe:
    """One instance per task process and file, with what it remembers."""
    return Bpe(text)


def _file(df: DataFrame, path: str):
    """The vocabulary file (a few MB, checked) as a broadcast text."""
    with open(path, encoding="utf-8") as f:
        text = f.read(64 << 20)
        if f.read(1):
            raise ValueError(f"{path}: over 64 MB, too large for a vocabulary file to broadcast")
    return df.sparkSession.sparkContext.broadcast(text)


def _per_text(docs: DataFrame, id_col: str, text_col: str, path: str, fields: list[StructField], make) -> DataFrame:
    shared = _file(docs, path)
    names = ["id", *[f.name for f in fields]]
    kind = StructType([StructField("id", docs.schema[id_col].dataType), *fields])
    arrow = [None, *[pa.list_(pa.int32()) if isinstance(f.dataType, ArrayType) else None for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                rows = [make(bpe, t) for t in b.column(1).to_pylist()]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), arrow[1:])]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return python_tasks(rows, run, kind).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, ids array<int>) of every row: its whole text as ids of the
    vocabulary file ``path``, no specials added. Null and empty texts: no ids.
    Rows with null or repeated ids come out as they are, other columns are
    ignored, whatever their names. Empty: empty."""

    def make(bpe: Bpe, text: str | None):
        return ([i for block in bpe.encode(text or "") for i in block],)

    return _per_text(docs, id_col, text_col, path, [StructField("ids", ArrayType(IntegerType()))], make)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(``id_col``, text) from ids, specials kept. Null or no ids: empty text."""

    def make(bpe: Bpe, ids: list[int] | None):
        d, ids = Decoder(bpe), ids or []
        return ("".join([d.feed(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]) + d.finish(),)

    return _per_text(rows, id_col, ids_col, path, [StructField("text", StringType())], make)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_tokens, ids_sha256, decoded_sha256): digests of the ids
    (decimal, joined by one space) and of the text decoded from them; blocks
    of ids go straight through encoder, decoder and digests, so a long text
    never stands in memory as ids. Rows as in :func:`encode`."""

    def make(bpe: Bpe, text: str | None):
        n, ids, back, d = 0, hashlib.sha256(), hashlib.sha256(), Decoder(bpe)
        for block in bpe.encode(text or ""):
            if block:
                ids.update(((" " if n else "") + " ".join([bpe.names[i] for i in block])).encode())
                back.update(d.feed(block).encode())
                n += len(block)
        back.update(d.finish().encode())
        return n, ids.hexdigest(), back.hexdigest()

    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return _per_text(docs, id_col, text_col, path, fields, make)
