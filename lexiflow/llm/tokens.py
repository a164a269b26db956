"""Encoding of texts with public tokenizer files, inside Python tasks.

Paths are parameters; ``vocab_path(name)`` finds the installed files.  The strings of special
tokens become their ids, as the ``tokenizers`` library does by default."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from lexiflow.llm.common import process_cache


def vocab_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    """The ``tokenizers`` library's object for a JSON file, single-threaded (Spark has the cores)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return process_cache(f"tok:{path}", lambda: Tokenizer.from_file(path))


def added_tokens(path: str) -> list[str]:
    """The strings that the library takes out of a text before it cuts it; texts that hold one go to the library."""
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def _byte_names() -> dict[str, int]:
    """The JSON files name bytes by printable characters: printable bytes by themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(plain))
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_bpe_encoder(path: str):
    """text -> uint32 ids of a byte-level BPE file (JSON of the ``tokenizers`` library).

    The merge work is done by tiktoken over the file's vocabulary (about five times as
    fast, same ids: tests compare them); a text it refuses goes to ``tokenizers``."""
    def make():
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        byte = _byte_names()
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if not token.startswith("<|")}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    enc, special = process_cache(f"bpe:{path}", make), process_cache(f"added:{path}", lambda: added_tokens(path))

    def encode(text: str) -> np.ndarray:
        if not any(s in text for s in special):
            try:
                return enc.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:
                # The regex engine gives up on some texts with a panic, a class that the library does not export.
                if type(e).__name__ != "PanicException":
                    raise
        return np.array(load_tokenizer(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    return encode


#: Characters of words that need none of a tokenizer's normalisation but lower case: printable ASCII and Latin letters.
_PLAIN = re.compile("[!-~\u00a1-\u024f\n]*")


class WordEndBpe:
    """Ids of BPE files with word ends (``</w>``) for text that only needs lower case.

    Text is cut by the file's own pattern and tiktoken merges over the file's
    vocabulary, with a space as the byte that ends a word (no token holds one)."""

    def __init__(self, spec: dict):
        import regex
        import tiktoken

        byte, ranks = _byte_names(), {}
        for token, i in spec["model"]["vocab"].items():
            core = token.removesuffix("</w>")
            if not token.startswith("<|") and core != "\u0120":  # the byte of the space itself
                ranks[bytes(byte[c] for c in core) + b" " * (core != token)] = i
        ranks[b" "] = len(spec["model"]["vocab"])
        self.enc = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.end = ranks[b"\n "]
        # Latin-1 characters: 0 part of a word or white space, 1 mark (a run of marks is one piece), 2 number (a piece each), 3 anything to look at closely.
        self.kinds = np.array([3 if c == "'" or (not c.isprintable() and c not in " \n") or c in "\xa0\xad" else
                               0 if c.isalpha() or c in " \n" else 2 if unicodedata.category(c)[0] == "N" else 1 for c in map(chr, range(256))], np.uint8)

    @classmethod
    def of(cls, path: str) -> WordEndBpe | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        return cls(spec) if spec["model"].get("end_of_word_suffix") == "</w>" and first.get("type") == "Split" and first.get("invert") else None

    def _ids(self, text: str) -> np.ndarray:
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype("<u2")

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each of some plain words."""
        ids = self._ids(" ".join(self.cut.findall("\n".join(words).lower() + "\n")) + " ")
        ends = np.flatnonzero(ids == self.end)
        raw, starts = ids.tobytes(), np.concatenate([[0], ends[:-1] + 1])
        return [raw[s:e] for s, e in zip((2 * starts).tolist(), (2 * ends).tolist())]

    def text(self, text: str) -> bytes | None:
        """Ids of a whole text that spaces around marks and numbers cut as the pattern would; None for other texts."""
        try:
            codes = np.frombuffer(text.encode("latin-1"), np.uint8)
        except UnicodeEncodeError:
            return None
        kinds = self.kinds[codes]
        mark = kinds == 1
        if kinds.max(initial=0) == 3 or (mark[1:] & mark[:-1]).any():
            return None
        text = text.lower().replace("\n", " ")
        for c in np.flatnonzero(np.bincount(codes[kinds > 0], minlength=1)).tolist():
            text = text.replace(chr(c), f" {chr(c)} ")
        return self._ids(text + " ").tobytes()


class WordMemo:
    """Ids of whole texts, for tokenizers that drop white space.

    Such a tokenizer never joins characters across a space, so a text's ids are those
    of its words in turn.  Simple texts go through ``WordEndBpe`` whole; others by remembered words, where
    new words of a batch are encoded together: plain ones by ``WordEndBpe``, all others by
    the ``tokenizers`` library itself (tests compare them).  ``limit`` bounds the memory (then the memo starts anew)."""

    def __init__(self, path: str, limit: int = 400_000):
        self.tok, self.limit, self.memo, self.fast = load_tokenizer(path), limit, {}, WordEndBpe.of(path)
        self.special = added_tokens(path)

    def _learn(self, words: list[str]) -> None:
        if self.fast:
            plain = words if _PLAIN.fullmatch("\n".join(words)) else [w for w in words if _PLAIN.fullmatch(w)]
            self.memo.update(zip(plain, self.fast.words(plain)))
            words = [] if len(plain) == len(words) else [w for w in words if w not in self.memo]
        for i in range(0, len(words), 4096):
            part = words[i:i + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                self.memo[w] = np.array(e.ids, dtype="<u2").tobytes()

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        whole = lambda t: np.array(self.tok.encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes()
        out = [whole(t) if any(s in t for s in self.special) else self.fast.text(t) if self.fast else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for at in range(0, len(rest), 256):
            part = rest[at:at + 256]
            split = [texts[i].replace("\n", " ").split(" ") for i in part]
            if len(self.memo) > self.limit:
                self.memo.clear()
            self._learn(list(set().union(*split).difference(self.memo)))
            get = self.memo.__getitem__
            for i, words in zip(part, split):
                out[i] = b"".join(map(get, words))
        return out
