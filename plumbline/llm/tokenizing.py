"""Fast exact encoding with public tokenizer libraries.

Both encoders cut a text at places where the tokenizer can be shown never to join what
stands left and right, encode each distinct part once by the library, and keep the result
in a bounded per-process cache.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Parts kept per Python worker; a full cache is emptied (about 110 MB).
CACHE_PARTS = 500_000
#: Parts longer than this are encoded but not kept.
CACHE_CHARS = 64

#: A word of Western letters, which lower-casing and composition leave one for one, and ASCII
#: marks behind it, the apostrophe aside.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class JsonEncoder:
    """``tokenizers`` encoding of whole texts to little-endian 32-bit ids.

    Blanks and newlines are cut places only if the tokenizer drops white space before its
    model runs and every pattern of its pre-tokenizer stays within runs free of white
    space; that is verified on construction by encoding probes.  Otherwise whole texts go to
    the library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("token ids are kept as little-endian 32-bit integers")

        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cache: dict[str, bytes] = {"": b""}
        self.limit = CACHE_PARTS
        self.words: dict[str, bytes] = {}
        self.cuts = self._drops_blanks()
        self.ends = self._word_ends() if self.cuts else None

    def _library(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _drops_blanks(self) -> bool:
        import json

        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        steps = pre.get("pretokenizers", [pre])
        split = next((s for s in steps if s.get("type") == "Split"), {})
        if split.get("behavior") != "Removed" or not split.get("invert"):
            return False
        if any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", [])):
            return False
        probes = ["a b", "it 's", "x\ny", "1 2", "! !", "e ́", "Σ a", "aΣ b"]
        return all(self._library(p) == b"".join(map(self._library, re.split("[ \n]", p))) for p in probes)

    def _word_ends(self) -> np.ndarray | None:
        """Whether each id ends a word, if the vocabulary marks that, and if probes show that a
        word is encoded alike in any capitals and before any marks; else None."""
        import json

        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        if not suffix:
            return None
        for w, t in (("Word", ",.!"), ("ÀÉß", '"'), ("thatre", "***"), ("X", "<|>"), ("ab", "$%&#()-/:;=?@[]^_`{|}~")):
            if self._library(w + t) != self._library(w.lower()) + self._library(t):
                return None
        ends = np.zeros(self.vocab_size, bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            ends[i] = token.endswith(suffix)
        return ends

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as bytes, four a token."""
        if not self.cuts:
            return self._library(text)
        parts = text.replace("\n", " ").split(" ")
        cache = self.cache
        new = set(parts).difference(cache)
        if not new:
            return b"".join(map(cache.__getitem__, parts))
        if len(cache) > self.limit:
            cache.clear()
            cache[""] = b""
            new = set(parts)
            new.discard("")
        kept = cache
        if any(len(p) > CACHE_CHARS for p in new):
            kept = dict.fromkeys(parts)
            kept.update((p, cache[p]) for p in kept if p in cache)
        for p, ids in self._encode_parts(new):
            kept[p] = ids
            if len(p) <= CACHE_CHARS:
                cache[p] = ids
        return b"".join(map(kept.__getitem__, parts))

    def _encode_parts(self, parts: set[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of each part.  Western words with marks behind them are cut before the marks, so
        that a word is encoded once for all capitals and marks it comes with."""
        words, cut, rest = self.words, [], []
        for p in parts:
            m = _WORD.fullmatch(p) if self.ends is not None else None
            if m:
                cut.append((p, m[1].lower(), m[2]))
            else:
                rest.append(p)
        if len(words) > self.limit:
            words.clear()
        new = list({w for _, w, _ in cut}.difference(words))
        if new:
            # one text of all words, cut again behind each token that ends a word
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) != len(new):
                raise ValueError("the tokenizer doesn't end each word with one final token")
            data, at = ids.tobytes(), 0
            for w, end in zip(new, ends.tolist()):
                words[w] = data[at:end]
                at = end
        marks = {t: b"" for _, _, t in cut}
        behind = [t for t in marks if t]
        for p, e in zip(behind, self.tokenizer.encode_batch_fast(behind, add_special_tokens=False)):
            marks[p] = array("I", e.ids).tobytes()
        for p, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)):
            yield p, array("I", e.ids).tobytes()
        for p, w, t in cut:
            yield p, words[w] + marks[t] if t else words[w]


@lru_cache(maxsize=4)
def json_encoder(path: str) -> JsonEncoder:
    return JsonEncoder(path)


class PieceCounter:
    """Token counts of a SentencePiece BPE model by the whole-token shortcut.

    The model joins neighbouring symbols only if the joined string is in its vocabulary.  If
    no vocabulary string holds the space mark after another character, nothing is ever joined
    across the start of a run of spaces, so each run of spaces with the word after it (a
    pre-token) is encoded on its own.  :meth:`prove` checks that on the vocabulary, and finds
    by encoding them which vocabulary strings of the form "mark + word" encode alone as one
    token.  Those count one each; only other pre-tokens go through the merge loop.
    """

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece as spm

        self.sp = spm.SentencePieceProcessor(model_file=path)
        self.independent, self.whole = self.prove()
        self.counts: dict[str, int] = {}

    def prove(self) -> tuple[bool, frozenset[str]]:
        sp, mark = self.sp, self.MARK
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        independent = all(mark not in p.lstrip(mark) for p in pieces)
        # the model must neither trim spaces nor rewrite text, and must put one space before it
        for probe in ("a", "  a", "a  ", " a  b", "éé", "ﬁ", "Ａ", "a\n b", "▁a"):
            independent &= sp.encode(probe, out_type=str) == self._spelled(probe)
        words = [p[1:] for p in pieces if len(p) > 1 and p[0] == mark and mark not in p[1:]]
        whole = frozenset(w for w, ids in zip(words, sp.encode(words, num_threads=1)) if len(ids) == 1)
        return independent, whole

    def _spelled(self, text: str) -> list[str]:
        out: list[str] = []
        for part in self._pretokens(text):
            out += self.sp.encode(part, out_type=str)
        return out

    def _pretokens(self, text: str) -> list[str]:
        """Pre-tokens without the space that the model itself puts before each."""
        if not text:
            return []
        parts = text.replace(self.MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for p in parts:
            if p:
                out.append(" " * spaces + p)
                spaces = 0
            else:
                spaces += 1
        if spaces:
            # a run of spaces at the end: the model adds one of them itself
            out.append(" " * (spaces - 1))
        return out

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.independent:
            return len(self.sp.encode(text))
        seen = Counter(self._pretokens(text))
        whole, counts = self.whole, self.counts
        total, rest = 0, []
        for part, n in seen.items():
            if part in whole:
                total += n
            elif part in counts:
                total += n * counts[part]
            else:
                rest.append((part, n))
        if rest:
            if len(counts) > CACHE_PARTS:
                counts.clear()
            for (part, n), ids in zip(rest, self.sp.encode([p for p, _ in rest], num_threads=1)):
                k = len(ids) if part else self._blank()
                total += n * k
                if len(part) <= CACHE_CHARS:
                    counts[part] = k
        return total

    @lru_cache(maxsize=1)  # noqa: B019  one instance per process
    def _blank(self) -> int:
        """Tokens of a lone space, which the library drops when a text is empty."""
        return len(self.sp.encode("a ")) - len(self.sp.encode("a"))


@lru_cache(maxsize=2)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
