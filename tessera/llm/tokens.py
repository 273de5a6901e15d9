"""Token ids of whole texts, as the tokenizers library gives them for a public tokenizer file.

``encoder`` gives the ids of ``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``;
an added token's text within a text is that token, as it is there. A byte-level BPE file
is run by the merge engine of tiktoken, which needs a quarter of the time, if the file is of
the one form for which both engines do the same (``_mergeable``); other files, and texts with
a longer run of white space than that engine's pattern can look through, are run by the
library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: The pre-tokenisation of byte-level BPE files that name none of their own (fixed values).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level BPE files: printable Latin-1 as itself, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


LONGEST_RUN = 100_000  # characters of white space; the pattern's look-ahead keeps each of a run
_WHITE = re.compile(r"\s+")


def _mergeable(spec: dict) -> bool:
    """Whether a file is plain byte-level BPE: ids in the order of merges, added tokens taken as they stand."""
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or ()
    if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return False
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return False
    vocab = model["vocab"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab[x] for x in made]
    plain = set(vocab) - {t["content"] for t in added}
    return ids == sorted(set(ids)) and plain == set(_byte_alphabet()) | set(made)


@lru_cache(maxsize=4)
def encoder(path: str, added_tokens: bool = True) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids; without ``added_tokens`` their texts are plain text."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    library: list[Tokenizer] = []

    def slow(text: str) -> np.ndarray:
        library[:] = library or [Tokenizer.from_file(path)]
        library[0].encode_special_tokens = not added_tokens
        return np.array(library[0].encode(text, add_special_tokens=False).ids, np.uint32)

    if not _mergeable(spec):
        return slow
    import tiktoken

    added = {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    alphabet = _byte_alphabet()
    ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    bpe = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> np.ndarray:
        if len(text) > LONGEST_RUN and max(map(len, _WHITE.findall(text)), default=0) > LONGEST_RUN:
            return slow(text)
        if added_tokens and any(x in text for x in added):
            return np.array(bpe.encode(text, allowed_special="all"), np.uint32)
        return np.array(bpe.encode_ordinary(text), np.uint32)

    return encode


@lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: of a byte-level BPE file, or of a piece model (U+2581 is a space, a byte piece its byte)."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces = ((i, model.id_to_piece(i)) for i in range(model.get_piece_size()))
        return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in pieces]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, added = _byte_alphabet(), {t["content"]: t["id"] for t in spec.get("added_tokens") or ()}
    ids = {i: bytes(alphabet[c] for c in x) for x, i in spec["model"]["vocab"].items() if x not in added} | {i: x.encode() for x, i in added.items()}
    return [ids.get(i, b"") for i in range(max(ids) + 1)]


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as few as possible, all full but perhaps the first."""
    if n <= capacity:
        return [(0, n)]
    head = (n - 1) % capacity + 1
    return [(0, head)] + [(s, capacity) for s in range(head, n, capacity)]
