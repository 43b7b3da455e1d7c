"""Whole texts to ids with a tokenizers file, the ids of repeated chunks being looked up.

A text is cut at places where the tokenizer itself always cuts, so each chunk gets the ids it has inside the
text. Tokenizers whose cuts are not known here encode whole texts, as do texts that hold an added token.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
from collections.abc import Callable

#: Unicode white space, as the tokenizers' patterns have it (str.split would also take U+001C to U+001F).
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: One space may lead a word; of other white space the last character stands alone before a word.
SPACED = f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: White space is dropped.
WORDS = f"[^{WHITE}]+"
GENERATION = 200_000
CACHED_LENGTH = 40
#: What texts in Latin-1 are cut into before merging, with the letters, digits and white space of Latin-1 spelled
#: out. Only contractions and other signs can begin alike, so their order is all that matters.
LETTER, DIGIT, BLANK = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
SPACED_PARTS = (
    f" ?[{LETTER}]+| ?[{DIGIT}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{LETTER}{DIGIT}{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
)
WORD_PARTS = f"[{LETTER}]+|[{DIGIT}]|'(?:s|t|re|ve|m|ll|d)|[^{LETTER}{DIGIT}{BLANK}]+"
#: The tokenizer's own pattern for the latter.
OWN_WORD_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def per_worker(key: object, make: Callable[[], object]) -> object:
    """Something made once in a Python worker and kept between its tasks."""
    held = sys.modules.setdefault("_steadyrun_worker", types.ModuleType("_steadyrun_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


class Recent(dict):
    """What ``make`` gives for short texts; those not asked for during two generations are forgotten."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            found = self.make(text)
        if len(text) <= CACHED_LENGTH:
            if len(self) >= GENERATION:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


def _form(config: dict) -> str | None:
    """Whether a tokenizer's configuration is one whose cuts are known: spaced or words."""
    normalizer, split, model = config.get("normalizer"), config.get("pre_tokenizer") or {}, config.get("model") or {}
    if model.get("type") != "BPE" or model.get("dropout"):
        return None
    if normalizer is None and split.get("type") == "ByteLevel":
        return "spaced" if split.get("use_regex") and not split.get("add_prefix_space") else None
    steps = split.get("pretokenizers") or []
    kinds = [x.get("type") for x in (normalizer or {}).get("normalizers", [])]
    if kinds == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in steps] == ["Split", "ByteLevel"]:
        first = steps[0]
        alike = first["behavior"] == "Removed" and first["invert"] and first["pattern"].get("Regex") == OWN_WORD_PARTS
        return "words" if alike and not steps[1].get("use_regex") and not steps[1].get("add_prefix_space") else None
    return None


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers.

    With ``added_tokens`` they are the ids of the library's defaults: the content of an added token, such as
    <|endoftext|>, is that token wherever a text has it. Without, it is text like any other.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        form = _form(config)
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added_tokens
        added = config.get("added_tokens") or [] if added_tokens else []
        if any(t.get("normalized") for t in added):
            form = None
        merged, letters = tokenizer.model.tokenize, _byte_letters()
        space = letters[0x20]

        def pack(ids: list[int]) -> bytes:
            return struct.pack(f"<{len(ids)}I", *ids)

        def part(text: str) -> bytes:
            if text.isascii() and text.isprintable():
                shown = text.replace(" ", space)
            else:
                shown = text.encode().decode("latin-1").translate(letters)
            return pack([t.id for t in merged(shown)])

        def chunk(text: str) -> bytes:
            return pack(tokenizer.encode(text, add_special_tokens=False).ids)

        self.form, self.chunk = form, chunk
        self.added = [t["content"] for t in added if t.get("content")]
        self.chunks = re.compile(SPACED if form == "spaced" else WORDS).findall
        self.parts = re.compile(SPACED_PARTS if form == "spaced" else WORD_PARTS).findall
        self.chunk_ids, self.part_ids = Recent(chunk).__getitem__, Recent(part).__getitem__

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.form is None or any(content in text for content in self.added):
            return self.chunk(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.chunk_ids, self.chunks(text)))
        return b"".join(map(self.part_ids, self.parts(text.lower() if self.form == "words" else text)))


def encoder(path: str, added_tokens: bool = False) -> Encoder:
    return per_worker(("encoder", path, added_tokens), lambda: Encoder(path, added_tokens))
