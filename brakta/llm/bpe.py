"""Token ids of a word-level BPE vocabulary, one white-space chunk at a time.

The vocabulary's normalizer drops white space and no pre-token crosses it, so a
text's ids are its chunks' ids in order, and a chunk met before needs no second
encoding.  ``WordBpe`` refuses vocabularies for which that does not hold;
``encoder`` then encodes whole texts with the library.
"""

from __future__ import annotations

import json
import re
from array import array

import regex
from tokenizers import Tokenizer

from brakta.llm.common import Memo, kept

#: str.split() takes these for white space, the vocabulary's pattern does not.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: itself if printable, else the next from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(spare)) for b in range(256)]


class WordBpe:
    """Chunk by chunk ids; exact, since what is not plain Latin goes through the library itself."""

    def __init__(self, path: str):
        if not path.endswith(".json"):
            raise ValueError(f"{path}: not a vocabulary of this kind")
        self.library = Tokenizer.from_file(path)
        config = json.loads(self.library.to_str())
        if not self.by_chunk(config):
            raise ValueError(f"{path}: chunks of white space do not encode apart")
        self.model = self.library.model
        split = config["pre_tokenizer"]["pretokenizers"][0]
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.letters = dict(enumerate(byte_letters()))
        # The same alternatives where all letters and digits are ASCII; Python's own engine is faster.
        self.ascii_pieces = re.compile(split["pattern"]["Regex"].replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]").replace(r"\p{L}\p{N}", "a-z0-9")).findall
        self.piece_ids = Memo(lambda piece: array("I", [t.id for t in self.model.tokenize(piece)]).tobytes(), limit=24 << 20, twice=True)

    @staticmethod
    def by_chunk(config: dict) -> bool:
        norm = [x["type"] for x in (config.get("normalizer") or {}).get("normalizers", [])]
        pre = (config.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return norm == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["behavior"] == "Removed" and r"|[\p{L}]+|" in pre[0]["pattern"].get("Regex", "") and not pre[1]["add_prefix_space"] and not pre[1]["use_regex"] and all(x["content"].startswith("<|") for x in config["added_tokens"]) and not any(x["lstrip"] or x["rstrip"] or x["normalized"] or any(map(str.isspace, x["content"])) for x in config["added_tokens"])

    def pre_tokens(self, chunk: str) -> list[str] | None:
        """The chunk's pre-tokens as the model reads them; None where only the library is sure.

        Below U+0250 all letters are composed already and lower case goes letter by
        letter (but for U+0130), so normal forms cannot differ.
        """
        if chunk.isascii():
            if "<|" in chunk:
                return None
            low = chunk.lower()
            if low.isalpha():
                return [low]
            if chunk.isprintable():
                return self.ascii_pieces(low)
        elif "<|" in chunk or max(chunk) >= "ɐ" or "İ" in chunk:
            return None
        else:
            low = chunk.lower()
        return [x if x.isascii() and x.isprintable() else x.encode().decode("latin-1").translate(self.letters) for x in self.pieces(low)]

    def chunk_ids(self, chunk: str) -> bytes:
        """The chunk's ids as little-endian unsigned 32-bit integers."""
        found = self.pre_tokens(chunk)
        if found is None:
            return self.library_ids(chunk)
        if len(found) == 1:
            return self.piece_ids[found[0]]
        return b"".join([self.piece_ids[x] for x in found])

    def library_ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def single_tokens(self) -> list[str]:
        """Vocabulary strings that, alone, encode as exactly one token: tried with the library, one by one."""
        byte = {c: b for b, c in self.letters.items()}
        words = []
        for entry in self.library.get_vocab(with_added_tokens=False):
            letters = entry.removesuffix("</w>")
            if entry != letters and all(c in byte for c in letters):
                try:
                    words.append(bytes(byte[c] for c in letters).decode())
                except UnicodeDecodeError:
                    continue
        words = [w for w in words if w and w.split() == [w]]
        return [w for w, e in zip(words, self.library.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1]


def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit integers; a Python worker keeps the words it has met, within the memos' bytes."""
    return kept(("encoder", path), lambda: make_encoder(path))


def make_encoder(path: str):
    try:
        own = WordBpe(path)
    except ValueError:
        library = Tokenizer.from_file(path)
        return lambda text: array("I", library.encode(text, add_special_tokens=False).ids).tobytes()
    get = Memo(own.chunk_ids, limit=48 << 20, twice=True).__getitem__

    def encode(text: str) -> bytes:
        if any(c in text for c in SEPARATORS):
            return own.library_ids(text)
        return b"".join(map(get, text.split()))

    return encode
