"""Whole-text tokenisation through the tokenizers library, with a cache of the pieces between single spaces.

A byte-level or word-level pre-tokenizer always starts a new token at a space between two other characters, and at a
line feed that stands alone, so a text is the sequence of its pieces there. A piece that isn't in the cache is cut into its pre-tokens by the vocabulary's own
expression, and those that aren't in the cache either go to the library's model together, many in a call; the lengths
of the tokens tell where each one ends. Pieces with characters other than Latin-1 letters, signs and line feeds, and
texts with other arrangements of white space, go to the library whole. Special tokens' strings in a text are ordinary
text.
"""

from __future__ import annotations

import json
import os
import re
from itertools import repeat

import numpy as np
import regex

from .common import CACHES

CACHE_PIECES = 1_000_000
LONGEST_PIECE = 64
MODEL_PIECES = 5000
FIRST = "\ufdd0"  # a noncharacter: marks what has no space before it; texts that hold it go whole
_PLAIN = re.compile(r"[\n\x21-\x7E\xA1-\xFF]+")
#: Fixed value: the expression of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_characters() -> str:
    """The visible character that stands for each byte in a byte-level vocabulary, in order of the bytes."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return "".join(chr(b if b in visible else next(hidden)) for b in range(256))


class Encoder:
    """Encodes texts to ids; its memory is bounded by a number of short pieces."""

    def __init__(self, path: str, pieces: int = CACHE_PIECES):
        self.limit = pieces
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spaced = self._keeps_spaces()
        self.cutter = self._cutter(spec)
        if self.cutter:
            bare = spec | {"normalizer": None, "post_processor": None, "added_tokens": [], "pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": "\n"}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            end = spec["model"].get("end_of_word_suffix") or ""
            words, merges = spec["model"]["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
            # unseen pre-tokens only: a cache of the library's own would never be hit
            kept = {k: spec["model"][k] for k in ("end_of_word_suffix", "ignore_merges", "fuse_unk") if spec["model"].get(k)}
            self.bare.model = BPE(words, merges, cache_capacity=0, **kept)
            del merges, bare
            self.length = np.zeros(max(words.values()) + 1, np.int64)
            for w, i in words.items():
                self.length[i] = len(w.removesuffix(end)) if end else len(w)
            self.byte_map = str.maketrans({b: c for b, c in enumerate(byte_characters())})
        del spec
        self.clear()

    def _keeps_spaces(self) -> bool:
        return self.model.encode(" a", add_special_tokens=False).ids != self.model.encode("a", add_special_tokens=False).ids

    def _cutter(self, spec: dict):
        """The pre-tokenizer's expression where it is one whose effect on plain pieces is known; else None."""
        before, normal, model = spec["pre_tokenizer"] or {}, spec["normalizer"], spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix"):
            return None
        if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
            self.lower = False
            return regex.compile(BYTE_LEVEL)
        steps, kinds = before.get("pretokenizers", []), [n["type"] for n in (normal or {}).get("normalizers", [])]
        if [s["type"] for s in steps] == ["Split", "ByteLevel"] and "Regex" in steps[0]["pattern"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]:
            if not steps[1]["use_regex"] and not steps[1]["add_prefix_space"] and kinds == ["NFC", "Replace", "Lowercase"]:
                self.lower = True
                return regex.compile(steps[0]["pattern"]["Regex"])
        return None

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.start, self.size, self.used = np.empty(1 << 14, np.int32), np.empty(1 << 14, np.int32), 0
        self.uses = np.zeros(1 << 14, np.int32)

    def shrink(self) -> None:
        """Keep the pieces met most often, up to half of the bound."""
        n = len(self.of)
        uses = self.uses[:n]
        least = 2
        while (uses >= least).sum() > self.limit // 2:
            least += 1
        kept = [(p, k) for p, k in self.of.items() if uses[k] >= least]
        ids, sizes = self._gather(np.array([k for _, k in kept], np.int32))
        self.clear()
        self._store([p for p, _ in kept], ids, sizes)

    def _store(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Append pieces with their ids, laid end to end."""
        k, n = len(self.of), len(pieces)
        while k + n > len(self.start):
            self.start, self.size = np.resize(self.start, 2 * len(self.start)), np.resize(self.size, 2 * len(self.size))
            self.uses = np.concatenate([self.uses, np.zeros(len(self.uses), np.int32)])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.of.update(zip(pieces, range(k, k + n), strict=True))
        self.size[k : k + n] = sizes
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _find(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.of.get, pieces, repeat(-1)), np.int32, len(pieces))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, end to end, and how many each has."""
        sizes = self.size[places]
        ends = np.cumsum(sizes, dtype=np.int32)
        take = np.repeat(self.start[places] - (ends - sizes), sizes)
        take += np.arange(len(take), dtype=np.int32)
        return self.flat[take], sizes

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _text(self, piece: str) -> str:
        if not self.spaced or piece.startswith("\n"):
            return piece
        return piece[len(FIRST) :] if piece.startswith(FIRST) else " " + piece

    def _refused(self, piece: str) -> bool:
        """Long pieces, and those with white space beside the space between pieces (a lone line feed starts a piece)."""
        if len(piece) > LONGEST_PIECE or not self.spaced:
            return len(piece) > LONGEST_PIECE
        return not piece or piece[0].isspace() and piece[0] != "\n" or piece[-1].isspace() and piece != "\n"

    def _learn(self, pieces: list[str]) -> None:
        easy = [p for p in pieces if p.isascii() and p.isalpha() and (not self.lower or p.islower())] if self.cutter else []
        self._learn_words(easy)
        pieces = [p for p in pieces if p not in self.of] if easy else pieces
        pieces, parts, counts = self._by_shape(pieces)
        joined, new, count = pieces[: len(counts)], {}, len(counts)
        pieces = pieces[count:]
        texts = list(map(self._text, pieces))
        plain = [bool(self.cutter and _PLAIN.fullmatch(t, 1 if t.startswith(" ") else 0)) for t in texts]
        for piece, ids in self._in_library([(p, t) for p, t, ok in zip(pieces, texts, plain, strict=True) if not ok]):
            self._store([piece], np.array(ids, np.uint32), np.array([len(ids)]))
        cut = self.cutter.findall if self.cutter else None
        for piece, text, ok in zip(pieces, texts, plain, strict=True):
            if not ok:
                continue
            own = cut(text.lower() if self.lower else text)
            if self.spaced:
                own = [p[1:] if p[0] == " " else p if p[0] == "\n" else FIRST + p for p in own]
            if len(own) == 1 and own[0] == piece:
                new[piece] = None
            else:
                joined.append(piece)
                parts += own
                counts.append(len(own))
        have = self._find(parts)
        new.update(dict.fromkeys(parts[j] for j in np.flatnonzero(have < 0)))
        self._learn_words([p for p in new if p not in self.of])
        if not joined:
            return
        missing = np.flatnonzero(have < 0)
        have[missing] = self._find([parts[j] for j in missing])
        self.uses[have] += 1
        ids, sizes = self._gather(have)
        ends = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(counts)]]
        mine = [j for j, p in enumerate(joined) if p not in self.of]  # a pre-token of another piece may be one itself
        if len(mine) < len(joined):
            ids = np.concatenate([ids[:0], *(ids[ends[j] : ends[j + 1]] for j in mine)])
        self._store([joined[j] for j in mine], ids, np.diff(ends)[mine])

    def _by_shape(self, pieces: list[str]) -> tuple[list[str], list[str], list[int]]:
        """Pieces of two frequent shapes first, letters with one sign after them or a line feed before them, with their
        pre-tokens and how many each has; then the others, which the expression cuts.
        """
        if not self.cutter:
            return pieces, [], []
        first, parts, rest, mark = [], [], [], FIRST if self.spaced else ""
        for p in pieces:
            if p.isascii() and p[:-1].isalpha() and p[-1:] in ".,;:!?" and (not self.lower or p.islower()):
                parts += (p[:-1], mark + p[-1])
            elif self.spaced and p[:1] == "\n" and p.isascii() and p[1:].isalpha():
                parts += ("\n", mark + p[1:])
            else:
                rest.append(p)
                continue
            first.append(p)
        return first + rest, parts, [2] * len(first)

    def _in_library(self, rest: list[tuple[str, str]]):
        return zip((p for p, _ in rest), self._whole([t for _, t in rest]), strict=True)

    def _learn_words(self, words: list[str]) -> None:
        """Pre-tokens by the model alone, thousands in a call."""
        space, easy = "\u0120" * self.spaced, lambda w: w.isascii() and w.isalpha()  # letters stand for themselves
        shown = [space + w if easy(w) else self._text(w).encode().decode("latin-1").translate(self.byte_map) for w in words]
        sizes = np.fromiter(map(len, shown), np.int64, len(shown))
        for i in range(0, len(words), MODEL_PIECES):
            ids = np.array(self.bare.encode_batch_fast(["\n".join(shown[i : i + MODEL_PIECES])], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(sizes[i : i + MODEL_PIECES])
            at = np.searchsorted(np.cumsum(self.length[ids]), ends, side="left") + 1
            if len(ids) != at[-1] or self.length[ids].sum() != ends[-1]:
                raise ValueError("the model's tokens don't spell its input")
            self._store(words[i : i + MODEL_PIECES], ids, np.diff(np.r_[0, at]))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.of) > self.limit:
            self.shrink()
        out: list = [None] * len(texts)
        odd, cut, every, counts = [], [], [], []
        for i, text in enumerate(texts):
            if self.spaced:
                if FIRST in text:
                    odd.append(i)
                    continue
                if "\n" in text:
                    if "\n\n" not in text:
                        text = text.replace("\n", " \n")
                    elif " \n" in text:
                        odd.append(i)
                        continue
                text = FIRST + text  # the other pieces stand for themselves with the space before them
            else:
                text = text.replace("\n", " ")
            pieces = text.split(" ")
            cut.append(i)
            every += pieces
            counts.append(len(pieces))
        places = self._find(every)
        missing = np.flatnonzero(places < 0)
        new = dict.fromkeys(every[j] for j in missing)
        refused = {p for p in new if self._refused(p)}
        self._learn([p for p in new if p not in refused])
        places[missing] = self._find([every[j] for j in missing])
        owner = np.repeat(np.arange(len(cut)), counts)
        if refused:  # texts with such pieces, which aren't kept, go whole
            whole = np.unique(owner[missing[places[missing] < 0]])
            odd += [cut[j] for j in whole]
            places[np.isin(owner, whole)] = 0
        if len(places) and len(self.of):
            self.uses[places] += 1
            ids, sizes = self._gather(places)
            ends = np.cumsum(np.bincount(owner, sizes, len(cut)).astype(np.int64))
            for i, lo, hi in zip(cut, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                out[i] = ids[lo:hi]
        if odd:
            for i, ids in zip(odd, self._whole([texts[i] for i in odd]), strict=True):
                out[i] = np.array(ids, np.uint32)
        return out


_ENCODERS: dict[str, Encoder] = {}
CACHES.append(_ENCODERS)


def encoder(path: str, pieces: int = CACHE_PIECES) -> Encoder:
    """One encoder a worker and vocabulary, kept over tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, pieces)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
