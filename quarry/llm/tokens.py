"""Token ids of whole texts, by a public tokenizer file and the tokenizers library.

Both byte-level tokenizers cut a text into pre-tokens and encode each alone, so
a pre-token met before need not be encoded again: a worker keeps the ids of those
met lately. Texts of ASCII and Latin
letters are cut here by the file's own pattern with its character classes
written out; only pre-tokens that aren't cached go to the library.
Encoder.encode_flat finds the cuts of a whole batch at once, on its bytes, and
looks up each distinct pre-token once. Texts with
any other character or an added token of the file (<|endoftext|>), and files
with another pipeline, go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quarry.llm import spans

LATIN = "A-Za-zÀ-ÖØ-öø-įı-ſ"
WHITE = r"\t-\r "
ODD = re.compile(rf"[^{WHITE}!-~{LATIN}]")
#: The pre-token patterns of the two files, for the characters that ODD doesn't find.
BYTES_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{WHITE}{LATIN}0-9]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
WORDS_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^{WHITE}{LATIN}0-9]+")
#: The byte-level alphabet, by its rule: printable bytes stand for themselves, the others for characters from 256 on, in order.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: Of a byte of UTF-8: 0 part of a letter, 1 digit, 2 another printed character, 3 white space; and whether ODD finds its character by it alone.
LETTER, DIGIT, OTHER, SPACE = range(4)
KINDS = np.full(256, OTHER, np.uint8)
KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = LETTER
KINDS[48:58] = DIGIT
KINDS[[32, *range(9, 14)]] = SPACE
ODD_BYTES = np.ones(256, bool)
ODD_BYTES[[*range(9, 14), *range(32, 127), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = False
#: Pre-tokens kept by a worker.
MOST_CACHED = 400_000


def added_tokens(plan: dict) -> re.Pattern | None:
    """Finds texts in which the library may see an added token; in any case of letters, as some are looked for in normalised text."""
    words = [x["content"] for x in plan.get("added_tokens") or [] if x["content"]]
    return re.compile("|".join(map(re.escape, words)), re.IGNORECASE) if words else None


class Words(dict):
    """Ids, as bytes, of pre-tokens: made by the model when one is asked for that isn't here.

    Those not asked for since the last but one turn are let go, so common ones stay and about `most` are kept.
    """

    def __init__(self, model, most: int):
        super().__init__()
        self.tokenize, self.most, self.old = model.tokenize, most, {}

    def __missing__(self, x: str) -> bytes:
        ids = self.old.pop(x, None)
        if ids is None:
            # of printable ASCII only the space has another character in the byte-level alphabet
            plain = x.replace(" ", chr(ALPHABET[32])) if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(ALPHABET)
            own = [t.id for t in self.tokenize(plain)]  # a pre-token needs no pipeline, only the model
            ids = struct.pack(f"<{len(own)}I", *own)
        self[x] = ids
        return ids

    def turn(self) -> None:
        if 2 * len(self) > self.most:
            self.old = dict(self)
            self.clear()


def odd_texts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether ODD finds a character, for each text: bytes data[at[i]:at[i + 1]]."""
    bad = ODD_BYTES[data]
    lead, next_ = data[:-1], data[1:]
    for first, second in ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0)):  # the signs of times and division, and the dotted capital I
        bad[:-1] |= (lead == first) & (next_ == second)
    out = np.zeros(len(at) - 1, bool)
    out[np.searchsorted(at, np.flatnonzero(bad), "right") - 1] = True
    return out


def byte_cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the matches of BYTES_CUT start in texts that ODD finds nothing in."""
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[at] = True
    kind = KINDS[data]
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before another character: a blank goes with it, any other is alone
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n])
    start[last] = True
    start[last[data[last] == 32] + 1] = False
    # 's 't 'm 'd 're 've 'll where a match starts with the apostrophe
    quote = np.flatnonzero(data == 39)
    quote = quote[start[quote] & ~first[quote + 1]]
    one = data[quote + 1]
    two = np.where(first[quote + 2 - first[quote + 1]], 0, data[np.minimum(quote + 2, n - 1)])
    short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
    long_ = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    start[quote[short | long_] + 1] = False
    ends = np.r_[quote[short] + 2, quote[long_] + 3]
    start[ends[ends < n]] = True
    return np.flatnonzero(start)


class Encoder:
    """encode(texts) -> ids of each as bytes, little-endian unsigned 32-bit. Travels as the file's path; each worker loads it once.

    added: a text's literal added tokens (<|endoftext|>) get their own ids, as by the library's defaults; otherwise they are plain text.
    """

    _loaded: dict[tuple, tuple] = {}

    def __init__(self, path: str, most_cached: int = MOST_CACHED, added: bool = False):
        self.path, self.most_cached, self.added = path, most_cached, added

    def _tools(self):
        if (self.path, self.added) not in self._loaded:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tool = Tokenizer.from_file(self.path)
            tool.encode_special_tokens = not self.added
            with open(self.path, encoding="utf-8") as f:
                plan = json.load(f)
            before, norm = plan.get("pre_tokenizer") or {}, plan.get("normalizer") or {}
            cut, lower, added = None, False, added_tokens(plan) if self.added else None
            if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
                cut = BYTES_CUT
            elif [x.get("type") for x in before.get("pretokenizers", [])] == ["Split", "ByteLevel"] and [x.get("type") for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and before["pretokenizers"][0]["pattern"].get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
                cut, lower = WORDS_CUT, True
            self._loaded[self.path, self.added] = (tool, cut, lower, added, Words(tool.model, self.most_cached))
        return self._loaded[self.path, self.added]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        tool, cut, lower, added, words = self._tools()
        whole = lambda xs: [np.array(e.ids, "<u4").tobytes() for e in tool.encode_batch_fast(xs, add_special_tokens=False)]
        out, odd = [b""] * len(texts), []
        for i, t in enumerate(texts):
            if t:
                if cut is None or ODD.search(t) or (added and added.search(t)):
                    odd.append(i)
                else:
                    out[i] = b"".join(map(words.__getitem__, cut.findall(t.lower() if lower else t)))
                    words.turn()
        for i, x in zip(odd, whole([texts[i] for i in odd]) if odd else [], strict=True):
            out[i] = x
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, place of each text's first, with an end): as encode, a batch at once."""
        _, cut, _, added, words = self._tools()
        data, at = spans.flat(texts)
        if cut is not BYTES_CUT or not len(data):
            found = self.encode(texts.to_pylist())
            return np.frombuffer(b"".join(found), "<u4"), np.r_[0, np.cumsum([len(x) // 4 for x in found], dtype=np.int64)]
        odd = odd_texts(data, at)
        if added:
            odd |= np.array(pc.match_substring_regex(texts, added.pattern, ignore_case=True).fill_null(False))
        if odd.any():  # these go one way, the others the other, and their ids are put in order
            plain, at_plain = self.encode_flat(texts.filter(pa.array(~odd)))
            some = self.encode(texts.filter(pa.array(odd)).to_pylist())
            counts = np.zeros(len(odd), np.int64)
            counts[~odd], counts[odd] = np.diff(at_plain), [len(x) // 4 for x in some]
            ends = np.r_[0, np.cumsum(counts)]
            out, own = np.empty(ends[-1], "<u4"), np.repeat(odd, counts)
            out[~own], out[own] = plain, np.frombuffer(b"".join(some), "<u4")
            return out, ends
        starts = byte_cuts(data, at)
        offsets = np.r_[starts, len(data)].astype(np.int32)
        pre = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        ids = list(map(words.__getitem__, pre.dictionary.to_numpy(zero_copy_only=False)))
        words.turn()
        counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))
        ends = np.r_[0, np.cumsum(counts[pre.indices.to_numpy()])]
        return lists.take(pre.indices).flatten().to_numpy(), ends[np.searchsorted(starts, at)]
