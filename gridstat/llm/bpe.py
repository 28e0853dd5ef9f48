"""Operator 3: BPE encoding and decoding as a bounded-lookahead streaming transducer.

A text is read piece by piece. Pre-tokens are cut as soon as they are certain;
inside a pre-token, symbols enter a table that keeps, for every prefix, its
unique last token. (A token sequence is the BPE encoding of its string exactly
if each pair of neighbours is; so the last token of a prefix is the one that
fits the last token of the prefix before it.) A token is emitted as soon as
`lookahead` symbols follow it: merges pass news leftwards only along chains of
ever later rules that share a piece, so the longest such chain of the merge
list bounds how far a later symbol can reach back. Which tokens end at a symbol is
said by an automaton of all tokens; which tokens may be neighbours, and what the
machine says of a whole short part, is kept in bounded caches.

Memory is constant: those caches, one input chunk, and the machine's buffer.
Letters, numbers and lower case are those of the tokenizers library: where Python's
tables have no character and a newer standard does, the library is asked, once a table.
Texts without white space are cut within a part, before a character that can't
join the one before it, and pre-tokens that span chunks stream through the
machine. Only a run of combining marks is held whole, as their order needs it.

Decoding is a state machine over token ids: `pieces` gives the tokens'
strings with a space between them, as the tokenizers library does for a
vocabulary without a decoder; `text` gives text, where bytes that do not yet
form a character are held back.

Defined results: null and empty texts have no tokens (the digests are those of
the empty string); whitespace only, likewise; repeated rows and repeated ids
give a row each; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from gridstat.llm.common import map_arrow, read_table, texts_of

#: Fixed values of the vocabulary's pre-tokenizer (public CLIP-style pattern), with its letters and numbers to fill in.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|%(L)s+|%(N)s|[^\s%(L)s%(N)s]+"
WORD_END = "</w>"

#: White space as the pre-tokenizer's regular expressions know it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0  -     　"

CHUNK_CHARS = 1 << 16  # characters of a text that are worked on at once
CACHED_CHARS = 48  # longer parts are not cached
CACHED_PARTS = 600_000  # entries of a worker's cache: parts between white space with their pre-tokens
CACHED_NEIGHBOURS = 200_000

#: White space for str.split() that the pre-tokenizer doesn't count as such.
_SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable character for each byte: printable bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class TwoAges(dict):
    """A bounded cache: what is used again moves from the older half to the younger one."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most // 2, {}

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@functools.cache
def _doubtful() -> tuple[str, ...]:
    """Characters that Python's tables lack and a newer standard has: what a library says of them depends on its age."""
    unknown = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Cn")
    return tuple(regex.findall(r"\P{Cn}", unknown))


def _classes(library: Tokenizer) -> tuple[str, str, dict[int, str]]:
    """Patterns of the library's letters and numbers, and the lower case of what Python doesn't lower."""
    kinds: dict[int, list[str]] = {1: [], 3: [], 4: []}
    for c in _doubtful():  # one piece: a letter; four: a number; three: a run of neither
        kinds[len(library.pre_tokenizer.pre_tokenize_str(f"a{c}{c}b"))].append(c)
    known = {p: set(regex.findall(p, "".join(_doubtful()))) for p in (r"\p{L}", r"\p{N}")}
    out = []
    for p, kind in ((r"\p{L}", 1), (r"\p{N}", 4)):
        more, less = sorted(set(kinds[kind]) - known[p]), sorted(known[p] - set(kinds[kind]))
        with_more = f"[{p}{''.join(more)}]"
        out.append(f"[{with_more}--[{''.join(less)}]]" if less else with_more)
    lower = {ord(c): low for c in _doubtful() if (low := library.normalizer.normalize_str(c)) != c}
    return out[0], out[1], lower


class MergeTable:
    """Vocabulary and merge rules, and what the transducer derives from them.

    Inside, a symbol is one character: its byte, or its byte plus 256 at the end
    of a word; so a token is a plain string with a character a symbol.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.byte_of = {c: b for b, c in byte_alphabet().items()}
        self.strings: dict[int, str] = {i: s for s, i in spec["model"]["vocab"].items()}
        self.ids: dict[str, int] = {self.inner(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        pairs = [(self.inner(a), self.inner(b)) for a, b in merges]
        self.rank: dict[tuple[str, str], int] = {p: r for r, p in enumerate(pairs)}
        self.parts: dict[str, tuple[str, str, int]] = {a + b: (a, b, r) for r, (a, b) in enumerate(pairs)}
        #: A token's bytes, and whether a word ends with it.
        self.bytes_of = {i: (bytes(ord(c) % 256 for c in t), ord(t[-1]) > 255) for t, i in self.ids.items()}
        self.longest = max(map(len, self.parts), default=1)
        #: Longest token that ends with two given symbols.
        self.reach: dict[str, int] = {}
        for token in self.parts:
            self.reach[token[-2:]] = max(self.reach.get(token[-2:], 1), len(token))
        self.lookahead = self._sufficient_lookahead(pairs)
        self.apart: dict[int, bool] = {}
        self.inner_of = {i: t for t, i in self.ids.items()}
        self.size_of = {i: len(t) for t, i in self.ids.items()}
        self._whole: dict[str, bool] = {}  # at most an entry a token
        #: All tokens, by the symbol that they end at: (number, symbols), longer ones first.
        self.ends = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.ends.add_word(token, (i, len(token)))
        self.ends.make_automaton()
        self.letter, self.number, self.lower = _classes(Tokenizer.from_file(path))

    def inner(self, token: str) -> str:
        """A token of the file with a character a symbol."""
        ends = token.endswith(WORD_END) and len(token) > len(WORD_END)
        symbols = [self.byte_of[c] for c in (token[: -len(WORD_END)] if ends else token)]
        if ends:
            symbols[-1] += 256
        return "".join(map(chr, symbols))

    @staticmethod
    def _sufficient_lookahead(pairs: list[tuple[str, str]]) -> int:
        """Symbols after a token beyond which nothing can change it.

        A rule can be influenced from its right through its right part: by a
        rule before it that took the part away (as its left part) or made it.
        The heaviest chain of such rules, each weighed by the symbols that it
        spans, bounds the distance; ranks order the chains, so one pass does.
        """
        taken: dict[str, int] = {}
        made: dict[str, int] = {}
        most = 1
        for a, b in pairs:
            reach = len(a + b) + max(taken.get(b, 0), made.get(b, 0))
            taken[a] = max(taken.get(a, 0), reach)
            made[a + b] = reach
            most = max(most, reach)
        return most + 1  # one more: a symbol at a word's end differs from the same symbol inside

    def _spine(self, token: str, right: bool) -> list[tuple[str, float]]:
        """The pieces at one edge of a token over the course of its merges, with the rank that ends each."""
        out: list[tuple[str, float]] = [(token, float("inf"))]
        while found := self.parts.get(token):
            token = found[1 if right else 0]
            out.append((token, found[2]))
        return out[::-1]

    def whole(self, token: str) -> bool:
        """Whether the rules build the token out of its own symbols."""
        known = self._whole.get(token)
        if known is None:
            found = self.parts.get(token)
            known = self._whole[token] = found is None or (
                self.whole(found[0]) and self.whole(found[1]) and self._stay_apart(found[0], found[1], found[2])
            )
        return known

    def cut(self, symbols: str) -> list[int]:
        """The tokens of a whole pre-token: for each end, the token that fits the last token before it."""
        last: list[int | None] = [None] * (len(symbols) + 1)
        apart, inner_of = self.apart, self.inner_of
        for end, (token, size) in self.ends.iter(symbols):
            end += 1
            if last[end] is None:
                at = end - size
                if at == 0:
                    if self.whole(inner_of[token]):
                        last[end] = token
                elif (neighbour := last[at]) is not None:
                    fits = apart.get(neighbour << 20 | token)
                    if self.fit(neighbour, token) if fits is None else fits:
                        last[end] = token
        out, end, size_of = [], len(symbols), self.size_of
        while end:
            token = last[end]
            if token is None:
                raise ValueError("symbols that the vocabulary lacks")
            out.append(token)
            end -= size_of[token]
        return out[::-1]

    def fit(self, a: int, b: int) -> bool:
        """Whether token b may follow token a: no rule joins their edges before each is finished."""
        known = self.whole(self.inner_of[b]) and self._stay_apart(self.inner_of[a], self.inner_of[b])
        if len(self.apart) > CACHED_NEIGHBOURS:
            self.apart.clear()
        self.apart[a << 20 | b] = known
        return known

    def _stay_apart(self, a: str, b: str, until: float = float("inf")) -> bool:
        """Whether no rule before rank `until` joins the edges of a and b."""
        left, right = self._spine(a, True), self._spine(b, False)
        born_l = -1.0
        for x, end_l in left:
            born_r = -1.0
            for y, end_r in right:
                if born_l <= end_r and born_r <= end_l:  # both there at some time
                    r = self.rank.get((x, y))
                    # At equal rank the leftmost place goes first: inside a before the seam, the seam before inside b.
                    if r is not None and r < until and r < end_l and r <= end_r:
                        return False
                born_r = end_r
            born_l = end_l
        return True


class PreTokenTransducer:
    """Symbols of one pre-token in, stable tokens (as numbers) out.

    Its state after some symbols is their last token. Up to CACHED_CHARS symbols are
    held until it is known whether the pre-token ends with them.
    """

    __slots__ = ("before", "held", "last", "table")

    def __init__(self, table: MergeTable):
        self.table = table
        self.held = ""  # symbols that are not emitted yet
        self.last: list[int | None] = [None]  # last[n]: the last token of the first n symbols held
        self.before: int | None = None  # the token before the symbols held

    def feed(self, symbols: str) -> list[int]:
        out: list[int] = []
        if self.before is None and len(self.last) == 1:
            if len(self.held) + len(symbols) <= CACHED_CHARS:
                self.held += symbols  # no token is stable yet, and no state needed
                return out
            symbols, self.held = self.held + symbols, ""
        room = 2 * self.table.lookahead + self.table.longest
        for at in range(0, len(symbols), room):
            self._extend(symbols[at : at + room])
            if len(self.held) > room:
                out += self._release(self.table.lookahead)
        return out

    def finish(self) -> list[int]:
        return self.table.cut(self.held) if len(self.last) == 1 else self._release(0)

    def _extend(self, symbols: str) -> None:
        """Find the last token of each longer prefix: the one that ends there and fits the last token before it."""
        last, before, table = self.last, self.before, self.table
        ids, reach, apart = table.ids.get, table.reach.get, table.apart.get
        begin, held = len(self.held), self.held + symbols
        self.held = held
        for n in range(begin + 1, len(held) + 1):
            found = None
            for at in range(max(0, n - reach(held[n - 2 : n], 1) if n > 1 else 0), n):  # a longer token is likelier
                token = ids(held[at:n])
                if token is None:
                    continue
                neighbour = last[at] if at else before
                if neighbour is None:
                    if at == 0 and table.whole(held[:n]):
                        found = token
                        break
                    continue
                fits = apart(neighbour << 20 | token)
                if table.fit(neighbour, token) if fits is None else fits:
                    found = token
                    break
            last.append(found)

    def _release(self, keep: int) -> list[int]:
        """Emit the tokens that end at least `keep` symbols before the end."""
        last, size_of = self.last, self.table.size_of
        at, path = len(self.held), []
        while at > 0:
            token = last[at]
            if token is None:
                raise ValueError("symbols that the vocabulary lacks")
            path.append((at, token))
            at -= size_of[token]
        path.reverse()
        stable = [(end, token) for end, token in path if end <= len(self.held) - keep]
        if stable:
            cut, self.before = stable[-1]
            self.held = self.held[cut:]
            del last[1 : cut + 1]
        return [token for _, token in stable]


@functools.cache
def joins_before(char: str) -> bool:
    """Whether a character may change what stands before it when both are composed: it mustn't begin a chunk."""
    first = unicodedata.normalize("NFD", char)[0]
    return unicodedata.combining(first) != 0 or 0x1161 <= ord(first) <= 0x11FF or first in _seconds()


@functools.cache
def _seconds() -> frozenset[str]:
    """Characters that are the second of a canonical pair."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x80, 0x110000))
    return frozenset(chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<"))


class LongPart:
    """A part without white space that spans chunks: normalised pieces in, (tokens, whether they go on a pre-token) out."""

    def __init__(self, encoder: StreamingEncoder):
        self.encoder = encoder
        self.rest = ""  # what may still belong to an unfinished pre-token
        self.machine: PreTokenTransducer | None = None  # inside a pre-token longer than a chunk
        self.goes_on: regex.Pattern | None = None  # what such a one consists of
        self.tail = b""  # its last byte: whether the word ends with it isn't known yet
        self.said = False

    def feed(self, piece: str) -> Iterator[tuple[list[int], bool]]:
        if self.machine is not None:
            end = self.goes_on.match(piece).end()
            yield from self._stream(piece[:end])
            if end == len(piece):
                return
            yield from self._end_of_word()
            piece = piece[end:]
        text, self.rest = self.rest + piece, ""
        pattern = self.encoder.pattern if not self.encoder.doubtful.isdisjoint(text) else self.encoder.usual
        for m in pattern.finditer(text):
            if m.end() > len(text) - 3:  # contractions look two characters ahead
                self.rest = text[m.start() :]
                break
            yield self.encoder.encode_word(m[0]), False
        if len(self.rest) > CHUNK_CHARS:
            self.machine, self.said = PreTokenTransducer(self.encoder.table), False
            self.goes_on = self.encoder.letters if self.encoder.letters.match(self.rest).end() else self.encoder.marks
            text, self.rest = self.rest, ""
            end = self.goes_on.match(text).end()
            yield from self._stream(text[:end])
            if end < len(text):
                yield from self._end_of_word()
                self.rest = text[end:]

    def finish(self) -> Iterator[tuple[list[int], bool]]:
        if self.machine is not None:
            yield from self._end_of_word()
        for w in self.encoder.words_of(self.rest):
            yield self.encoder.encode_word(w), False
        self.rest = ""

    def _stream(self, piece: str) -> Iterator[tuple[list[int], bool]]:
        raw = self.tail + piece.encode("utf-8")
        self.tail = raw[-1:]
        yield from self._emitted(self.machine.feed(raw[:-1].decode("latin-1")))

    def _end_of_word(self) -> Iterator[tuple[list[int], bool]]:
        ids = self.machine.feed(chr(256 + self.tail[0])) + self.machine.finish()
        yield from self._emitted(ids)
        self.machine, self.tail = None, b""

    def _emitted(self, ids: list[int]) -> Iterator[tuple[list[int], bool]]:
        if ids:
            yield ids, self.said
            self.said = True


class StreamingEncoder:
    """Text in, chunk by chunk; pre-tokens and their tokens out."""

    def __init__(self, table: MergeTable):
        self.table = table
        names = {"L": table.letter, "N": table.number}
        self.pattern = regex.compile("(?V1)" + PRE_TOKEN % names)
        self.usual = regex.compile(PRE_TOKEN % {"L": r"\p{L}", "N": r"\p{N}"})  # the same where no character is doubtful, and faster
        self.doubtful = frozenset(_doubtful())
        self.letters, self.marks = regex.compile(f"(?V1){table.letter}*"), regex.compile(r"(?V1)[^\s%(L)s%(N)s]*" % names)
        self.lower, self.lowered = table.lower, re.compile("[" + "".join(map(chr, table.lower)) + "]") if table.lower else None
        self.stop = regex.compile(f"[{SPACES}]")
        self.specials = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        self.special_chars = max(map(len, table.special), default=0)

    def parts(self, text: str) -> Iterator[tuple[list[str], bool, bool]]:
        """(normalised parts without white space, whether they are special tokens, whether the last one goes on in the next chunk).

        Pre-tokens never hold white space, so each part has its own. Chunks end
        before white space, if there is some within another chunk's length.
        """
        at, size = 0, len(text)
        while at < size:
            end, goes_on = min(size, at + CHUNK_CHARS), False
            if end < size:
                cut = self.stop.search(text, end, min(size, end + CHUNK_CHARS))
                if cut:
                    end = cut.start()
                elif end + CHUNK_CHARS >= size:
                    end = size
                else:
                    end = self._cut(text, end)
                    goes_on = end < size
            chunk = text[at:end] if at or end < size else text
            if self.specials and any(s in chunk for s in self.table.special):
                begin = 0
                for m in self.specials.finditer(chunk):
                    yield self._split(chunk[begin : m.start()]), False, False
                    yield [m[0]], True, False
                    begin = m.end()
                chunk = chunk[begin:]
            goes_on = goes_on and bool(chunk) and not self.stop.match(chunk[-1])
            yield self._split(chunk), False, goes_on
            at = end

    def _cut(self, text: str, end: int) -> int:
        """A place near `end` where a text may be cut: outside special tokens, before a character that joins none before it."""
        for m in self.specials.finditer(text, max(0, end - self.special_chars), end + self.special_chars) if self.specials else ():
            if m.start() < end < m.end():
                end = m.end()
        while end < len(text) and joins_before(text[end]):
            end += 1
        return end

    def _split(self, text: str) -> list[str]:
        """Parts of a text in NFC, each character in lower case on its own (no final sigma)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.lowered and self.lowered.search(text):
                text = text.translate(self.lower)
        text = text.lower()
        if _SEPARATORS.search(text):  # white space for str.split() alone
            return [p for p in self.stop.split(text) if p]
        return text.split()

    def words_of(self, part: str) -> list[str]:
        """The pre-tokens of a part without white space."""
        if part.isascii() or self.doubtful.isdisjoint(part):
            return self.usual.findall(part)
        return self.pattern.findall(part)

    def encode_word(self, word: str) -> list[int]:
        """The tokens of one pre-token."""
        raw = word.encode("utf-8")
        symbols = raw[:-1].decode("latin-1") + chr(256 + raw[-1])
        if len(symbols) <= CACHED_CHARS:
            return self.table.cut(symbols)
        machine = PreTokenTransducer(self.table)
        return machine.feed(symbols) + machine.finish()

    def stream(self, text: str) -> Iterator[tuple[list[str], bool] | tuple[None, tuple[list[int], bool]]]:
        """(parts, whether special) of a text; for parts that span chunks, (None, (tokens, whether they go on a pre-token))."""
        long: LongPart | None = None
        for parts, special, goes_on in self.parts(text):
            if long is not None:
                if parts:
                    yield from ((None, got) for got in long.feed(parts[0]))
                if len(parts) != 1 or special or not goes_on:
                    yield from ((None, got) for got in long.finish())
                    long = None
                parts = parts[1:]
            if goes_on and long is None and parts:
                if parts[:-1]:
                    yield parts[:-1], special
                long = LongPart(self)
                yield from ((None, got) for got in long.feed(parts[-1]))
            elif parts:
                yield parts, special
        if long is not None:
            yield from ((None, got) for got in long.finish())

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for parts, special in self.stream(text):
            if parts is None:
                out += special[0]
            else:
                for p in parts:
                    out += [self.table.special[p]] if special else [i for w in self.words_of(p) for i in self.encode_word(w)]
        return out


class StreamingDecoder:
    """Token ids in, text out, holding back no more than an unfinished character."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.special = set(table.special.values())
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.reset()

    def reset(self) -> None:
        self.utf8.reset()
        self.started = False
        self.gap = False

    def pieces(self, ids: Iterable[int]) -> str:
        """The tokens' strings, each after the first with a space before it."""
        said = " ".join([self.table.strings[i] for i in ids])
        if said and self.started:
            said = " " + said
        self.started = self.started or bool(said)
        return said

    def text(self, ids: Iterable[int]) -> str:
        """Characters that are complete; a token with a word's end owes a space to the next one."""
        out, held, bytes_of = [], b"", self.table.bytes_of
        for i in ids:
            if self.gap:
                out.append(self.utf8.decode(held) + self.finish() + " ")
                held, self.gap = b"", False
            if i in self.special:
                out.append(self.utf8.decode(held) + self.finish() + self.table.strings[i])
                held, self.gap = b"", True
            else:
                raw, self.gap = bytes_of[i]
                held += raw
        out.append(self.utf8.decode(held))
        return "".join(out)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


#: What encoding and decoding give for a part of text: (ids, pieces, text), each space-joined.
Entry = tuple[str, str, str]


class PartCache:
    """Entries of parts of text, each kept as one string of its three columns."""

    def __init__(self, table: MergeTable):
        self.encoder, self.decoder = StreamingEncoder(table), StreamingDecoder(table)
        self.table = table
        self.known = TwoAges(CACHED_PARTS)  # parts, and the pre-tokens that they consist of
        self.special = {s: "\t".join(self._decoded(s, [i])) for s, i in table.special.items()}

    def _decoded(self, word: str, ids: list[int]) -> Entry:
        d = self.decoder
        d.reset()
        return " ".join(map(str, ids)), d.pieces(ids), d.text(ids) + d.finish()

    def _kept(self, part: str, held: str) -> str:
        return self.known.keep(part, held) if len(part) <= CACHED_CHARS else held

    def _word(self, word: str) -> str:
        got = self.known.get(word) or self.known.old.get(word)
        return got if got is not None else self._kept(word, "\t".join(self._decoded(word, self.encoder.encode_word(word))))

    def of(self, part: str) -> str:
        """What is held of a part that is not in the younger half of the cache."""
        got = self.known.old.get(part)
        if got is not None:
            return self.known.keep(part, got)
        words = self.encoder.words_of(part)
        if len(words) == 1:
            return self._word(words[0])
        return self._kept(part, "\t".join(_columns(map(self._word, words))))

    def entries(self, text: str) -> Iterator[tuple[Entry, bool]]:
        """The entry of each chunk's parts, and whether its text goes on the one before."""
        of, known, decoder = self.of, self.known.get, StreamingDecoder(self.table)
        for parts, said in self.encoder.stream(text):
            if parts is None:
                ids, goes_on = said
                if not goes_on:
                    decoder.reset()
                decoder.started = False
                yield (" ".join(map(str, ids)), decoder.pieces(ids), decoder.text(ids)), goes_on
            elif said:
                yield _columns([self.special[p] for p in parts]), False
            else:
                yield _columns([known(p) or of(p) for p in parts]), False


def _columns(held: Iterable[str]) -> Entry:
    """The entry of several parts in a row."""
    flat = "\t".join(held).split("\t")
    return " ".join(flat[::3]), " ".join(flat[1::3]), " ".join(flat[2::3])


@functools.cache
def cache_of(path: str) -> PartCache:
    """One table and cache for each worker process and vocabulary."""
    return PartCache(MergeTable(path))


def drop_kept() -> None:
    """Forget what this worker process keeps for later tasks."""
    cache_of.cache_clear()


OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, text_sha256 string"


def digest(cache: PartCache, text: str) -> tuple[int, str, str, str]:
    """Token count and SHA-256 of ids, decoded pieces and decoded text, updated as tokens become stable."""
    n, hashes, gap = 0, [hashlib.sha256() for _ in range(3)], ""
    for entry, goes_on in cache.entries(text):
        n += entry[0].count(" ") + 1
        for k, (h, said) in enumerate(zip(hashes, entry, strict=True)):
            h.update((said if goes_on and k == 2 else gap + said).encode("utf-8"))
        gap = " "
    return n, *(h.hexdigest() for h in hashes)


def encode_decode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every whole text; digests of both directions. Row-local: no shuffle."""

    def task():
        cache = cache_of(vocabulary)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [digest(cache, t) for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c) for c in zip(*rows, strict=True))],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "text_sha256"],
            )

        return one

    return map_arrow(docs.select("doc_id", "text"), task, OUT)


def token_ids(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>): the ids themselves, for a training job."""

    def task():
        cache = cache_of(vocabulary)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [
                [int(i) for entry, _ in cache.entries(t) for i in entry[0].split(" ")]
                for t in texts_of(batch)
            ]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["a", "b"])

        return one

    return map_arrow(docs.select("doc_id", "text"), task, "doc_id long, ids array<int>")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all of `documents`."""
    return encode_decode(read_table(spark, sf_dir, "documents"), default_vocabulary())
