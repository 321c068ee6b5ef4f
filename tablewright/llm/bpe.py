"""Byte-level BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash over its bytes says so, which gives equal
passages equal chunks wherever they stand. A chunk that a worker has met before,
in whatever document, isn't encoded again. What a cut does to the tokens near it is
repaired: the text around each join, one piece wider on either side than what is
kept, goes through the tokenizer again, and the join counts as repaired once the
tokens at both rims agree with what stands there; until then the chunks beside it
become one and are encoded anew.

Why that is exact: white space after a character that is none always begins a new
pre-token, whatever stands before or after. Such places ("rims") split a text into
pieces whose tokens don't depend on the rest. The chunk store and the piece store
hold a bounded number of bytes in each Python worker and start anew when full.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import map_rows

#: The four control characters are white space to Python but not to the tokenizer.
PIECE = re.compile(r"[^\S\x1c-\x1f]*(?:[\S\x1c-\x1f])+|[^\S\x1c-\x1f]+")
#: Signs of which any number at the end of a word may be encoded by themselves, after an ASCII letter.
SIGNS = ".,;:!?"
WINDOW, MASK, SHORTEST, LONGEST = 32, 511, 128, 8192
_GEAR = np.random.default_rng(20).integers(0, 2**32, 256, dtype=np.uint32)


def cuts(data: bytes) -> list[int]:
    """Where chunks end: content alone decides, within SHORTEST and LONGEST bytes of the last end."""
    if len(data) <= SHORTEST:
        return [len(data)]
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after each step h covers 2k bytes
        h[k:] += h[:-k] << np.uint32(k)
    found, last = [], 0
    for p in [*(np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1).tolist(), len(data)]:
        while p - last > LONGEST:
            last = _whole(data, last + LONGEST)
            found.append(last)
        p = _whole(data, p)
        if p - last >= SHORTEST or (p == len(data) and p > last):
            found.append(p)
            last = p
    return found


def _ends(text: str) -> tuple[str, str, str, str, str] | None:
    """First piece, second, all between, last but one, last; None for too few pieces."""
    if not (a := PIECE.match(text)) or not (b := PIECE.match(text, a.end())):
        return None
    near = PIECE.findall(text[-160:])
    if len(near) < 4:
        near = PIECE.findall(text)
    last, tail = near[-2:]
    end = len(text) - len(last) - len(tail)
    return (a[0], b[0], text[b.end() : end], last, tail) if end > b.end() else None


def _whole(data: bytes, p: int) -> int:
    while p < len(data) and data[p] & 0xC0 == 0x80:
        p += 1
    return p


class Coder:
    """Texts to ids (little-endian unsigned 32-bit) and back; one for each worker and tokenizer file.
    The vocabulary stays with the worker, and so do the words of ``whole`` (at most about
    ``word_bytes``); ``forget`` empties the other stores, which tasks do when they end.

    Pieces not met before go to the library itself (engine "library"), or to a second
    encoder with the same vocabulary that is quicker on short strings (engine "ranks");
    that one is used only if the file's merges are in the order of their ids, and texts with
    added tokens or strings that it can't take go to the library.
    """

    _made: dict[tuple[str, str], Coder] = {}

    @classmethod
    def of(cls, path: str, engine: str = "ranks") -> Coder:
        if (path, engine) not in cls._made:
            cls._made[path, engine] = cls(path, engine)
        return cls._made[path, engine]

    def __init__(self, path: str, engine: str = "ranks", piece_bytes: int = 32 << 20, chunk_bytes: int = 16 << 20, word_bytes: int = 128 << 20) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.most = {"pieces": piece_bytes, "chunks": chunk_bytes, "joins": chunk_bytes // 2}
        self.pieces: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple | None] = {}
        self.joins: dict[str, bytes | None] = {}
        self.held = dict.fromkeys(self.most, 0)
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most_words, self.held_words = word_bytes, 0
        self.encoded_chunks = self.reused_chunks = 0
        vocab = self.library.get_vocab(with_added_tokens=True)
        back = _byte_of_char()
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ranks = _by_ranks(self.library, self.bytes_of) if engine == "ranks" else None

    def forget(self) -> None:
        for store in self.most:
            getattr(self, store).clear()
        self.held = dict.fromkeys(self.most, 0)

    def _keep(self, store: str, key, value, size: int) -> None:
        if self.held[store] + size > self.most[store]:
            getattr(self, store).clear()
            self.held[store] = 0
        getattr(self, store)[key] = value
        self.held[store] += size

    def raw(self, texts: list[str]) -> list[bytes]:
        """Straight from the encoder, without stores."""
        if self.ranks is not None:
            try:
                return [array("I", self.ranks(t)).tobytes() if len(t) < 100_000 else self.by_library([t])[0] for t in texts]
            except BaseException as e:  # its panics aren't Exceptions
                if isinstance(e, KeyboardInterrupt | SystemExit | GeneratorExit):
                    raise
        return self.by_library(texts)

    def in_runs(self, pieces: list[str], run: int = 512) -> list[bytes]:
        """From the library, many pieces to a call: as pieces keep to themselves, the ids of a
        run of them are cut again where the bytes of a piece are used up."""
        out: list[bytes] = []
        for at in range(0, len(pieces), run):
            part = pieces[at : at + run]
            if any(p[0] not in " \n" for p in part):
                part_ids = self.by_library(part)
            else:
                ids = self.by_library(["".join(part)])[0]
                used = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
                ends = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in part])
                to = np.searchsorted(used, ends) + 1
                if (used[to - 1] == ends).all():
                    to = (4 * to).tolist()
                    part_ids = [ids[a:b] for a, b in zip([0, *to], to, strict=False)]
                else:
                    part_ids = self.by_library(part)
            out += part_ids
        return out

    def whole(self, texts: list[str | None]) -> list[bytes]:
        """As encode(), from words alone."""
        ids, n = self.in_one(pa.array(texts, pa.string()))
        ends = np.cumsum(n)
        return [ids[a:b].tobytes() for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]

    def in_one(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """As encode(), in one array, with the number of ids of each text; ``end_id`` follows each text.

        Texts are dealt into words, of which the library encodes each once. A word begins before a
        space or a line feed; its key leaves a leading space out, and a text's first word, which has
        none, has a space at the end of its key. A text where white space follows on white space has
        words without ids, and goes by pieces."""
        column = pc.fill_null(texts, "")
        split = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        starts = np.asarray(split.offsets)
        first = starts[:-1] - starts[0]
        flat = split.flatten()
        words = flat.dictionary_encode()
        which = np.array(words.indices)
        keys = words.dictionary.to_pylist()
        which[first] = np.arange(len(keys), len(keys) + len(first))
        keys += [k + " " for k in flat.take(pa.array(first)).to_pylist()]
        ids_of = self._ids_of(keys)
        table = np.frombuffer(b"".join(ids_of), "<u4")
        sizes = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) // 4
        n = sizes[which]
        odd = np.maximum.reduceat(n == 0, first) if len(first) else np.zeros(0, bool)
        for a in self.added:
            odd |= np.asarray(pc.match_substring(column, a))
        if end_id is not None:  # as a word of one id behind each text
            table, sizes, at = np.append(table, np.uint32(end_id)), np.append(sizes, 1), np.append(first, len(which))[1:]
            which, n = np.insert(which, at, len(ids_of)), np.insert(n, at, 1)
            first = first + np.arange(len(first))
        lengths = np.add.reduceat(n, first) if len(first) else np.zeros(0, np.int64)
        total = int(n.sum())
        kind = np.int32 if max(total, len(table)) < 1 << 31 else np.int64
        begin = (np.cumsum(sizes) - sizes)[which]
        begin -= np.cumsum(n) - n
        at = np.repeat(begin.astype(kind), n)
        at += np.arange(total, dtype=kind)
        ids = table[at]
        if odd.any():
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            tail = np.array([] if end_id is None else [end_id], np.uint32)
            for i in np.flatnonzero(odd).tolist():
                t = column[i].as_py()
                mine = self.by_library([t]) if any(a in t for a in self.added) else self.by_pieces([PIECE.findall(t)])
                parts[i] = np.concatenate((np.frombuffer(mine[0], "<u4"), tail))
            ids, lengths = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, lengths

    def _ids_of(self, keys: list[str]) -> list[bytes]:
        """The ids of words by their keys; none for those that are no words by themselves.
        When half the store is full, it becomes ``older``, from which a word comes back when it is met."""
        if self.held_words > self.most_words // 2:
            self.older, self.words, self.held_words = self.words, {}, 0
        known, older = self.words, self.older
        got = list(map(known.get, keys))
        new = [i for i, ids in enumerate(got) if ids is None]
        if not new:
            return got
        met = [keys[i] for i in new]
        back = list(map(older.get, met))
        known.update(zip(met, back, strict=True))
        stems, ends, signed, todo = [], [], [], set()
        for k in [k for k, ids in zip(met, back, strict=True) if ids is None]:
            last = k[-1:]
            if not last.strip() and (not k[:-1] or last != " " or k[-2].isspace()):
                known[k] = b""
            # a letter and what isn't one never share a pre-token, so signs at the end go by themselves
            elif last in SIGNS and (stem := k.rstrip(SIGNS))[-1:].isalpha() and stem[-1].isascii():
                signed.append(k)
                stems.append(stem)
                ends.append(k[len(stem) :] + " ")
            else:
                todo.add(k)
        parts = [k for k in {*stems, *ends} if known.get(k) is None]
        back = list(map(older.get, parts))
        known.update(zip(parts, back, strict=True))
        todo.update(k for k, ids in zip(parts, back, strict=True) if ids is None)
        pieces = {k: k[:-1] if k[-1] == " " else k if k[0] == "\n" else " " + k for k in todo}
        fresh = sorted(pieces, key=lambda k: pieces[k][0] in " \n")
        known.update(zip(fresh, self.in_runs([pieces[k] for k in fresh]), strict=True))
        known.update((k, known[stem] + known[end]) for k, stem, end in zip(signed, stems, ends, strict=True))
        for i, k in zip(new, met, strict=True):
            got[i] = known[k]
        for some in (met, parts):
            self.held_words += 180 * len(some) + 3 * sum(map(len, some))
            for k in some:
                if len(k) > 64 and k in known:
                    self.held_words -= 180 + 3 * len(k)
                    del known[k]
        return got

    def by_library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def by_pieces(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of lists of pieces; pieces not met before go to the library in one batch."""
        known = self.pieces
        new = sorted(set(chain.from_iterable(parts)).difference(known), key=lambda p: p[0] in " \n")
        if not new:
            return [b"".join(map(known.__getitem__, part)) for part in parts]
        if self.held["pieces"] > self.most["pieces"]:
            known.clear()
            self.held["pieces"] = 0
            return self.by_pieces(parts)
        known.update(zip(new, self.raw(new) if self.ranks is not None else self.in_runs(new), strict=True))
        out = [b"".join(map(known.__getitem__, part)) for part in parts]
        for p in new:
            if len(p) > 64:
                del known[p]
            else:
                self.held["pieces"] += 180 + 3 * len(p)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """As the library's encode(add_special_tokens=False).ids; a null text is an empty one."""
        split: list[list[bytes] | None] = []
        new: dict[bytes, tuple | None] = {}
        local: dict[bytes, tuple | None] = {}
        for text in texts:
            data, at, chunks = (text or "").encode("utf-8", "surrogatepass"), 0, []
            if any(a in (text or "") for a in self.added):
                split.append(None)
                continue
            for p in cuts(data) if data else []:
                chunk = data[at:p]
                at = p
                chunks.append(chunk)
                if chunk in self.chunks:
                    self.reused_chunks += 1
                    local[chunk] = self.chunks[chunk]
                elif chunk not in new:
                    new[chunk] = _ends(chunk.decode("utf-8", "surrogatepass"))
                else:
                    self.reused_chunks += 1
            split.append(chunks)
        # what stands between the first and the last rim of a chunk is the same in any text
        inner = {c: ends for c, ends in new.items() if ends}
        if self.ranks is not None:
            encoded = self.raw([e[2] for e in inner.values()])
        else:
            encoded = self.by_pieces([PIECE.findall(e[2]) for e in inner.values()])
        for (c, (head, first, _, last, tail)), ids in zip(inner.items(), encoded, strict=True):
            local[c] = (head, first, ids, last, tail)
            self._keep("chunks", c, local[c], 400 + 2 * len(c) + len(ids))
        self.encoded_chunks += len(new)
        plans = [None if chunks is None else self._plan(chunks, local) for chunks in split]
        now = self._repair({x for plan in plans if plan for x in plan if isinstance(x, tuple)})
        out = []
        for text, chunks, plan in zip(texts, split, plans, strict=True):
            ids = self._joined(plan, now) if plan is not None else None
            if ids is None:
                ids = self.by_library([text])[0] if chunks is None else self._widened(chunks, local)
            out.append(ids)
        return out

    def _plan(self, chunks: list[bytes], local: dict) -> list:
        """Joins (before, middle, after) and the ids of what stands between them, in turn."""
        plan, open_text, before = [], "", ""
        for c in chunks:
            got = local.get(c)
            if got is None:  # too few rims: part of the join
                open_text += c.decode("utf-8", "surrogatepass")
            else:
                head, first, ids, last, tail = got
                plan += [(before, open_text + head, first), ids]
                before, open_text = last, tail
        return [*plan, (before, open_text, "")]

    @staticmethod
    def _joined(plan: list, now: dict) -> bytes | None:
        parts = [now[x] if isinstance(x, tuple) else x for x in plan]
        return None if None in parts else b"".join(parts)

    def _widened(self, chunks: list[bytes], local: dict) -> bytes:
        """Ids of a text whose joins don't all agree: the chunks beside a join that doesn't become
        one, which is encoded anew, until all joins agree or the text is a single chunk."""
        chunks, local = list(chunks), dict(local)
        while len(chunks) > 1:
            plan = self._plan(chunks, local)
            now = self._repair({x for x in plan if isinstance(x, tuple)})
            if (ids := self._joined(plan, now)) is not None:
                return ids
            bad = next(i for i, x in enumerate(plan[::2]) if now[x] is None)
            whole = [i for i, c in enumerate(chunks) if local.get(c) is not None]  # a join for each, and one at the end
            at = max(1, whole[bad] if bad < len(whole) else len(chunks) - 1)
            chunks[at - 1 : at + 1] = [chunks[at - 1] + chunks[at]]
            ends = _ends(chunks[at - 1].decode("utf-8", "surrogatepass"))
            local[chunks[at - 1]] = ends and (ends[0], ends[1], self.raw([ends[2]])[0], ends[3], ends[4])
        return self.by_library([b"".join(chunks).decode("utf-8", "surrogatepass")])[0]

    def _repair(self, joins: set[tuple[str, str, str]]) -> dict[tuple, bytes | None]:
        """Ids of before + middle + after for each join, where the library's ids of the whole
        begin with those of ``before`` and end with those of ``after``; None where they don't.
        A join's ids hold its rims', which the chunks' own leave out."""
        now = {x: self.joins[k] for x in joins if (k := "\0".join(x)) in self.joins}
        todo = [x for x in joins if x not in now]
        rims = [[p] if p else [] for x in todo for p in (x[0], x[2])]
        rim_ids = self.by_pieces(rims)
        for i, (x, ids) in enumerate(zip(todo, self.raw(["".join(x) for x in todo]) if todo else [], strict=True)):
            agree = ids.startswith(rim_ids[2 * i]) and ids.endswith(rim_ids[2 * i + 1])
            now[x] = ids if agree else None
            if len(ids) < 2000:
                self._keep("joins", "\0".join(x), now[x], 300 + 2 * sum(map(len, x)) + len(ids))
        return now

    def decode(self, ids: bytes) -> str:
        """As the library's decode(ids, skip_special_tokens=False)."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def _by_ranks(library, bytes_of: list[bytes]):
    """The quick encoder, or None where the file isn't a plain byte-level BPE whose ids follow its merges."""
    import json

    import tiktoken

    spec = json.loads(library.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    vocab, added = model.get("vocab"), {t["id"] for t in spec["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", [])]
    made = [vocab["".join(m)] for m in merges]
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or spec["normalizer"] or model.get("ignore_merges") or made != sorted(made) or len(made) + 256 != len(vocab) - len(added & set(vocab.values())):
        return None
    ranks = {bytes_of[i]: i for i in vocab.values() if i not in added}
    # the pattern that byte-level pre-tokenizers of this kind share
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself,
    the rest for the code points from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def round_trip(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, engine: str = "ranks") -> DataFrame:
    """Encode every whole text, decode the ids again: doc_id, n_tokens, ids_sha256,
    decoded_sha256, and with ``with_ids`` the ids (binary, little-endian 32-bit) and the
    decoded text.

    A null text is an empty one (0 tokens). Null and repeated ids are kept, a row for each
    row; other columns are dropped, whatever their names. Nothing is shuffled.
    """
    kind = dict(df.dtypes)[doc_id]

    def make():
        coder = Coder.of(tokenizer, engine)

        def work(columns: list[list]) -> list[list]:
            ids_of, n, ids_sha, text_sha, kept, texts = columns[0], [], [], [], [], []
            for at in range(0, len(ids_of), 256):
                for ids in coder.encode(columns[1][at : at + 256]):
                    decoded = coder.decode(ids)
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                    if with_ids:
                        kept.append(ids)
                        texts.append(decoded)
            return [ids_of, n, ids_sha, text_sha, *([kept, texts] if with_ids else [])]

        work.end = coder.forget
        return work

    schema = f"`{doc_id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return map_rows(df.select(F.col(doc_id), F.col(text)), schema, make)
