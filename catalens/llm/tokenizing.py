"""Byte-level BPE in tasks: ids exactly as the tokenizers library gives them."""

from __future__ import annotations

import json
import re
import sys
import types

import numpy as np

from catalens.shipping import ship_by_value

ship_by_value(__name__)

#: How the byte-level pre-tokenizer cuts a text. Fixed value.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: Characters beyond Latin-1 whose classes are the same in both libraries (tested one by one).
_OTHER = re.compile("[^\u0000-ԯ‐-‧]")


def _byte_of_sign() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return signs | {chr(256 + n): b for n, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with the file of a tokenizer.

    Where the vocabulary is in merge order, texts in common scripts go through tiktoken with the same
    merges, which is several times faster; all others go through tokenizers itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_padding()
        self.exact.no_truncation()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.decimal = [str(n) for n in range(self.size)]
        self.fast = self._fast(spec)

    def _fast(self, spec: dict):
        import tiktoken

        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space")
        if not plain or spec.get("normalizer") or model.get("dropout") or model["type"] != "BPE":
            return None
        byte = _byte_of_sign()
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        if ids != sorted(ids):
            return None
        ranks = {
            bytes(byte[c] for c in token): n
            for token, n in model["vocab"].items()
            if token not in self.special
        }
        return tiktoken.Encoding(
            "byte-level", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}
        )

    def _common(self, text: str) -> bool:
        if self.fast is None or self._special.search(text):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not _OTHER.search(text)
        return True

    def encode(self, text: str) -> np.ndarray:
        if self._common(text):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def decode(self, ids: np.ndarray, common: bool) -> str:
        if common and self.fast is not None:
            return self.fast.decode_bytes(ids.tolist()).decode("utf-8", "replace")
        return self.exact.decode(ids.tolist(), skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    """The encoder of a file, kept by the Python worker from task to task."""
    kept = sys.modules.setdefault("_kept_by_worker", types.ModuleType("_kept_by_worker")).__dict__
    if ("encoder", path) not in kept:
        kept["encoder", path] = Encoder(path)
    return kept["encoder", path]
