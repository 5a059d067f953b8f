"""Token ids of a public byte-level BPE vocabulary."""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The words of byte-level BPE before merging, as the vocabulary's own description gives them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of() -> dict[str, int]:
    """Byte-level vocabularies write a printable byte as its own character and the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The encoding of a tokenizers JSON file.

    The ids of a byte-level BPE vocabulary are its merge ranks, which is what tiktoken needs; it gives
    the same ids as tokenizers with add_special_tokens=False, five times as fast. A special token's
    string in a text is that token, as tokenizers has it by default.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    of = _bytes_of()
    ranks = {bytes(of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


#: Long runs of what the pattern takes for whitespace.
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def _in_parts(enc, text: str) -> np.ndarray:
    """Ids of a text with runs of whitespace that are too long for the pattern's matcher.

    By the pattern such a run is one piece, but for its last character where text follows that is no
    special token; what stands between runs does not depend on them.
    """
    out, at = [], 0
    for m in RUN.finditer(text):
        end = m.end()
        if end < len(text) and not any(text.startswith(s, end) for s in enc.special_tokens_set):
            end -= 1
        out.append(enc.encode_to_numpy(text[at : m.start()], allowed_special="all"))
        out.append(np.array(enc._encode_single_piece(text[m.start() : end].encode()), dtype="<u4"))
        at = end
    out.append(enc.encode_to_numpy(text[at:], allowed_special="all"))
    return np.concatenate(out)


def ids(path: str, text: str | None) -> np.ndarray:
    """Ids of a whole text, of any length, as unsigned 32-bit integers; none for a null or empty text."""
    enc = encoder(path)
    try:
        return enc.encode_to_numpy(text or "", allowed_special="all").astype("<u4", copy=False)
    except ValueError:
        return _in_parts(enc, text).astype("<u4", copy=False)
