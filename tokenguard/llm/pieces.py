"""Pre-tokens of tokenizer files: pieces of a text that are encoded alone as they are inside the text.

A sentencepiece model merges over the whole text, white space included. But a merge over a boundary would make a piece that
holds both characters there. So a text can be cut where a space follows another character, if no piece of the model has a
space behind anything but spaces, on both sides of a character that is in no longer piece, and between letters and signs that
no piece holds side by side. What lies between the cuts is encoded alone behind a mark, a character that merges with nothing.

A byte-level file (JSON) brings its own pattern, and strings of its added tokens stand alone.
"""

from __future__ import annotations

import re

from tokenguard.llm.common import KEPT

SPACE = "▁"


class SentencePieces:
    """A .model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = ["" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i) for i in range(n)]
        longer = [x for i, x in enumerate(names) if len(x) > 1 and not sp.is_byte(i)]
        if any(SPACE in x.lstrip(SPACE) for x in longer) or "".join(sp.encode(" ﬁ  ①a ", out_type=str)).startswith(SPACE * 2 + "f"):
            raise ValueError("texts can't be cut into pre-tokens for this model")
        joins = set("".join(longer)) - {SPACE}
        self.mark = next(c for c in map(chr, [10, 9, *range(1, 32)]) if c not in joins)
        self.skip = len(sp.encode(self.mark))
        letters = {c for c in joins if c.isalnum()}
        met = {(a, b) for x in longer for a, b in zip(x, x[1:]) if SPACE not in (a, b)}
        while mixed := {c for a, b in met if (a in letters) != (b in letters) for c in (a, b)} & letters:
            letters -= mixed
        inside, own, others = ("".join(map(re.escape, sorted(x))) for x in (joins, letters, joins - letters))
        runs = "|".join(f"[{x}]+" for x in (own, others) if x)
        self.find = re.compile(f" *(?:{runs})| +|[^{inside} ]").findall
        self.bytes_of = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text, in order, with the space that the model puts in front."""
        return self.find((" " + text).replace(SPACE, " ")) if text else []

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x[self.skip :] for x in self.model.encode([self.mark + w for w in words], num_threads=1)]

    def count(self, words: list[str]) -> list[int]:
        return [len(x) - self.skip for x in self.model.encode([self.mark + w for w in words], num_threads=1)]


class BytePieces:
    """A .json file of byte-level BPE; pattern cuts texts into words."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tokenizers

        self.model = tokenizers.Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        added = sorted((t.content for t in self.model.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.find = regex.compile(pattern).findall
        self.added = set(added)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")").split if added else lambda text: [text]

    def split(self, text: str) -> list[str]:
        return [w for part in self.cut(text) for w in ([part] if part in self.added else self.find(part))]

    def count(self, words: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode_batch(words, add_special_tokens=False)]


def pieces_of(path: str, pattern: str | None = None, owner: str = "pieces"):
    """The file's pre-tokens and counts, made once in a Python worker."""
    kept = KEPT.setdefault(owner, {})
    if (path, pattern) not in kept:
        kept[path, pattern] = SentencePieces(path) if path.endswith(".model") else BytePieces(path, pattern)
    return kept[path, pattern]
