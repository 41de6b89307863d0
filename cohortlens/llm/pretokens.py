"""Splitting text into the pre-tokens of a ``tokenizers`` file.

Byte-pair encoding never crosses a pre-token, so the ids of a text are the ids
of its pre-tokens in order and every pre-token needs encoding once per worker.

Three ways, each exact:

* texts of plain characters (ASCII and Latin letters): ``str.lower`` and one
  ``re`` pattern equal to the file's own for those characters;
* texts with other characters: the library's own normaliser and pre-tokeniser;
* texts holding the start of a special string: the library's ``encode``.
"""

from __future__ import annotations

import json
import os
import re

#: Characters for which the ``re`` pattern, ``str.lower`` and NFC agree with the library.
_PLAIN = re.compile(r"[\t\n\x0b\x0c\r\x20-\x7eÀ-įı-ſ]*")
#: The word-BPE file's split, written for plain characters in lower case.
_SPLIT = re.compile(r"[a-zß-öø-ſ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9ß-öø-ſ]+")
#: The split the pattern above stands for; other files take the library's own way.
_SPLIT_OF_FILE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_characters() -> list[str]:
    """The byte-level alphabet: visible Latin-1 bytes stand for themselves, the
    others follow from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + others.index(b)) for b in range(256)]


_BYTE = _byte_characters()


class PreTokenizer:
    """Pre-tokens of one tokenizer file; made once per Python worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.model = self.tok.model
        spec = json.loads(self.tok.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        lower = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.plain_ok = len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _SPLIT_OF_FILE and steps[1]["type"] == "ByteLevel" and lower == ["NFC", "Replace", "Lowercase"]

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens as text, or None when only ``whole`` is right.  Words from
        the library's own way are marked by a leading NUL (they are already in
        its byte alphabet)."""
        if any(s in text for s in self.special):
            return None
        if self.plain_ok and _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower())
        norm = self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text
        return ["\0" + p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(norm)]

    def ids(self, pretoken: str) -> list[int]:
        """Ids of one pre-token returned by ``split``."""
        if pretoken[:1] == "\0":
            pretoken = pretoken[1:]
        elif not pretoken.isascii():  # visible ASCII is the same in the byte alphabet
            pretoken = "".join([_BYTE[b] for b in pretoken.encode()])
        return [t.id for t in self.model.tokenize(pretoken)]

    def whole(self, text: str) -> list[int]:
        """Ids of a text by the library itself."""
        return self.tok.encode(text, add_special_tokens=False).ids


_MADE: dict[str, PreTokenizer] = {}


def pretokenizer(path: str) -> PreTokenizer:
    """The worker's tokenizer for ``path``: a file on every machine."""
    if path not in _MADE:
        _MADE[path] = PreTokenizer(path)
    return _MADE[path]


class WorkerCache(dict):
    """pre-token -> value of ``make``; emptied when it reaches ``most`` entries,
    so a worker's memory does not grow with the corpus."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
