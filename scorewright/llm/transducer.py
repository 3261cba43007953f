"""Operator 8: BPE encoding by a bounded-lookahead transducer, and decoding by
an incremental byte-to-text machine."""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import record, slices, tidy
from .bpe import PreTokenizer, load_lookahead, load_table, merge_ragged

#: Most words that a Python worker remembers, and the longest of them.
CACHE_WORDS, CACHE_CHARS = 120_000, 64
#: Characters that are split, encoded and decoded at once.
BLOCK = 1 << 18
_words: dict[str, dict] = {}
_SPACE = re.compile(r"[ \t\n\r]")


class Encoder:
    """Streams of base symbols in, token ids out.

    Each stream holds a window of at most ``lookahead + step`` symbols.  When
    the window is full and the stream goes on, the tokens that end at least
    ``lookahead`` symbols before its end are final (see
    ``bpe.sufficient_lookahead``) and are emitted; the rest is kept.  Memory
    for a stream is constant however long it is.  The windows of all streams
    are merged together, one numpy call per step."""

    def __init__(self, path: str, step: int = 4096):
        self.path, self.table = path, load_table(path)
        self.lookahead = load_lookahead(path)
        self.window = self.lookahead + max(step, max(map(len, self.table.tokens.values())) + 1)

    def streams(self, feeds: list[bytes]) -> list[list[int]]:
        t = self.table
        if not any(len(f) > self.window for f in feeds):  # every stream is one window
            ids, n = merge_ragged(t, *t.symbols(feeds))
            ids, n = ids.tolist(), n.tolist()
            return [ids[b - k : b] for b, k in zip(itertools.accumulate(n), n, strict=True)]
        width = np.fromiter((len(t.tokens[i]) - (len(t.suffix) if t.suffix and t.tokens[i].endswith(t.suffix) else 0) if i in t.tokens else 0 for i in range(t.size)), np.int64, t.size)
        out: list[list[int]] = [[] for _ in feeds]
        at = [0] * len(feeds)
        live = [i for i, f in enumerate(feeds) if f]
        while live:
            ends = [min(len(feeds[i]), at[i] + self.window) for i in live]
            last = [e == len(feeds[i]) for i, e in zip(live, ends, strict=True)]
            views = [feeds[i][at[i] : e] for i, e in zip(live, ends, strict=True)]
            sym, lens = t.symbols(views)
            if t.suffix and not all(last):  # the last symbol of an open window isn't a word's end
                close = np.cumsum(lens) - 1
                for k, done in enumerate(last):
                    if not done:
                        sym[close[k]] = t.base[views[k][-1]]
            ids, n = merge_ragged(t, sym, lens)
            cut = np.cumsum(n)
            again = []
            for k, i in enumerate(live):
                own = ids[cut[k] - n[k] : cut[k]]
                if not last[k]:
                    size = np.cumsum(width[own])
                    keep = int(np.searchsorted(size, len(views[k]) - self.lookahead, side="right"))
                    own = own[:keep]
                    at[i] += int(size[keep - 1])
                    again.append(i)
                out[i].extend(own.tolist())
            live = again
        return out


class Decoder:
    """Token ids in, text out, some ids at a time.

    ``plain``: the bytes of the tokens as text, a word-end mark as a space; the
    state is the unfinished character, at most three bytes, and bytes that are
    no UTF-8 give U+FFFD.  Otherwise the text that the tokenizer file defines:
    it names no decoder, so tokens are set apart by one space, and the state is
    whether a token was seen."""

    def __init__(self, path: str, plain: bool = True):
        self.table, self.plain = load_table(path), plain
        self.pieces = load_pieces(path, plain)
        self.reset()

    def reset(self) -> None:
        self._state, self._started = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: list[int]) -> str:
        if self.plain:
            return self._state.decode(b"".join(map(self.pieces.__getitem__, ids)))
        gap, self._started = " " * (self._started and bool(ids)), self._started or bool(ids)
        return gap + " ".join(map(self.pieces.__getitem__, ids))

    def finish(self) -> str:
        rest = self._state.decode(b"", True)
        self.reset()
        return rest


@functools.lru_cache(maxsize=4)
def load_pieces(path: str, plain: bool) -> list:
    """What each token decodes to, by id: its bytes (``plain``) or its string."""
    t = load_table(path)
    if not plain:
        return [t.tokens.get(i) for i in range(t.size)]

    def piece(tok: str) -> bytes:
        if tok in t.special:
            return tok.encode()
        end = bool(t.suffix) and tok.endswith(t.suffix)
        return bytes(t.letter_byte[c] for c in (tok[: -len(t.suffix)] if end else tok)) + b" " * end
    return [piece(t.tokens[i]) if i in t.tokens else None for i in range(t.size)]


@functools.lru_cache(maxsize=4)
def load_numbers(path: str) -> list[int]:
    """One object per token id, for all words that hold it."""
    return list(range(load_table(path).size))


@functools.lru_cache(maxsize=4)
def load_digits(path: str) -> list[str]:
    """Each token id as decimal digits."""
    return list(map(str, load_numbers(path)))


class Codec:
    """Encodes texts block by block, with the words seen so far remembered."""

    def __init__(self, path: str):
        self.path, self.table = path, load_table(path)
        self.split, self.encoder = PreTokenizer(path, self.table), Encoder(path)
        self.number = load_numbers(path)
        self.known = _words.setdefault(path, {})
        # words hold no white space, so a text may be cut at any
        self.whole = any(_SPACE.search(s) for s in self.table.special)

    def blocks(self, text: str, size: int):
        """The text in blocks of about ``size`` characters, cut before white space."""
        at = 0
        while at < len(text):
            cut = None if self.whole else _SPACE.search(text, at + size)
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def encode(self, blocks: list[str]) -> list[list[int]]:
        """The ids of each block."""
        split = [self.split(b) for b in blocks]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        known, local = self.known, {}
        fresh = [w for w in set().union(*split) if w not in known]
        strings = [w for w in fresh if isinstance(w, str)]
        found = self.encoder.streams([w.encode() for w in strings])
        for w, ids in [*zip(strings, found, strict=True), *((w, [w]) for w in fresh if not isinstance(w, str))]:
            (known if isinstance(w, str) and len(w) <= CACHE_CHARS else local)[w] = tuple(map(self.number.__getitem__, ids))
        known.update(local)  # one look for each word
        out = [list(itertools.chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
        for w in local:
            del known[w]
        return out


class Stream:
    """One text's way through the codec: ids in, digests out.  Of the text and
    its ids nothing is kept (the ids only if they are asked for)."""

    def __init__(self, path: str, keep: bool):
        self.n, self.ids, self.digits = 0, [] if keep else None, load_digits(path)
        self.id_sha, self.shown_sha, self.plain_sha = hashlib.sha256(), hashlib.sha256(), hashlib.sha256()
        self.shown, self.plain = Decoder(path, plain=False), Decoder(path)

    def feed(self, ids: list[int]) -> None:
        if ids:
            self.id_sha.update((" " * (self.n > 0) + " ".join(map(self.digits.__getitem__, ids))).encode())
            self.shown_sha.update(self.shown.feed(ids).encode())
            self.plain_sha.update(self.plain.feed(ids).encode())
            self.n += len(ids)
            if self.ids is not None:
                self.ids += ids

    def finish(self) -> tuple:
        self.plain_sha.update(self.plain.finish().encode())
        return (self.n, *(h.hexdigest() for h in (self.id_sha, self.shown_sha, self.plain_sha)), *(() if self.ids is None else (self.ids,)))


def run_streams(texts: Iterable[str], path: str, keep: bool = False, block: int = BLOCK) -> Iterator[tuple]:
    """``Stream.finish`` of each text.  Blocks of several short texts are
    encoded together, a long text's in turn, so what is held beside the given
    texts is about ``block`` characters and their words."""
    codec = Codec(path)
    held: list[tuple[Stream, str]] = []
    size, open_ = 0, []

    def flush():
        for (stream, _), ids in zip(held, codec.encode([b for _, b in held]), strict=True):
            stream.feed(ids)
        held.clear()

    for text in texts:
        stream = Stream(path, keep)
        for b in codec.blocks(text, block):
            held.append((stream, b))
            size += len(b)
            if size >= block:
                flush()
                yield from (s.finish() for s in open_)
                size, open_ = 0, []
        open_.append(stream)
    flush()
    yield from (s.finish() for s in open_)


def encode_ids(texts: list[str], path: str) -> list[list[int]]:
    """Token ids of each text."""
    return [r[-1] for r in run_streams(texts, path, keep=True)]


def decode_ids(ids: list[int], path: str, plain: bool = True) -> str:
    """Text of the ids through the incremental machine, one at a time."""
    d = Decoder(path, plain)
    return "".join(d.feed([i]) for i in ids) + d.finish()


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256,
    plain_sha256, and the ids themselves if asked for.

    The ids that come out of the transducer go through the decoders as they
    come, and what these say is hashed: ``decoded_sha256`` is of the decoding
    that the file itself defines (it has no decoder, so its tokens are joined by
    one space), ``plain_sha256`` of the byte-to-text machine's text.  Row by
    row, without a shuffle.  A null text counts as empty; a null doc_id stays
    null; repeated rows each give a row; an empty table gives none; other
    columns are not read.  Whole texts, in blocks of about ``BLOCK`` characters
    cut at white space; a word of any length streams through a constant window,
    so beside the given text memory doesn't grow with its length."""
    digests = ("ids_sha256", "decoded_sha256", "plain_sha256")
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.string()) for c in digests]]
    schema = pa.schema([*fields, *[("ids", pa.list_(pa.int32()))] * with_ids])

    def run(batches):
        for b in slices(batches, limit=1 << 20):
            yield record(schema, b.column(0), *zip(*run_streams(b.column(1).to_pylist(), path, with_ids)))

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(
        tidy(run), "doc_id long, n_tokens long, " + ", ".join(f"{c} string" for c in digests) + ", ids array<int>" * with_ids)
