"""Finding a text file's encoding from its first bytes."""

from __future__ import annotations

import codecs
import re
from dataclasses import dataclass

# Encodings that are tried, with what they are, and byte order marks.
ENCODINGS = {
    "utf-8": "Unicode (UTF-8)", "shift_jis": "Japanese (Shift_JIS)", "euc_jp": "Japanese (EUC-JP)", "iso2022_jp": "Japanese (ISO-2022-JP)",
    "utf-16-le": "Unicode (UTF-16LE)", "utf-16-be": "Unicode (UTF-16BE)", "iso8859-1": "Western (ISO-8859-1)", "cp1252": "Western (Windows-1252)",
}
MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
#: Encodings that Spark's own readers take.
NATIVE = {"utf-8": "UTF-8", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "iso8859-1": "ISO-8859-1"}
PROBE = 65536


@dataclass(frozen=True)
class Detected:
    encoding: str
    confidence: float


def normalize(name: str) -> str:
    """One name for each encoding, whatever alias is given."""
    return codecs.lookup(name).name


def supported() -> list[str]:
    return list(ENCODINGS)


def describe(name: str) -> str:
    return ENCODINGS.get(normalize(name), name)


def corruption(text: str) -> float:
    """Replacement characters count 1, control characters 0.5, inverted marks 0.3, by a thousand characters at most."""
    odd = text.count("�") + 0.5 * len(re.findall(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", text)) + 0.3 * len(re.findall("[¿¡]", text))
    return odd / max(1, min(1000, len(text)))


def has_japanese(text: str) -> bool:
    return re.search(r"[぀-ヿ一-龯]", text) is not None


def decode(data: bytes, encoding: str) -> str:
    for mark, name in MARKS:
        if name == encoding and data.startswith(mark):
            data = data[len(mark) :]
    return codecs.getincrementaldecoder(encoding)("replace").decode(data)


def detect(data: bytes, fallback: str = "utf-8", least: float = 0.3) -> Detected:
    """The encoding of a file that starts with ``data``: a mark, else the candidate that decodes most cleanly."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return Detected(name, 1.0)
    if not data or all(b < 128 and b != 0x1B for b in data):
        return Detected("utf-8", 1.0)
    if re.search(rb"\x1b\$[B@]|\x1b\([BJ]", data):
        return Detected("iso2022_jp", 0.95)
    zeros = data[0::2].count(0), data[1::2].count(0)
    if max(zeros) > 0.2 * len(data) / 2:
        return Detected("utf-16-be" if zeros[0] > zeros[1] else "utf-16-le", 0.9)
    best = Detected(fallback, 0.0)
    for name, bonus in (("utf-8", 0.2), ("shift_jis", 0.0), ("euc_jp", 0.05), ("cp1252", -0.25)):
        text = decode(data, name)
        sure = max(0.0, 0.8 + bonus - 10 * corruption(text))
        if name in ("shift_jis", "euc_jp"):
            kana = len(re.findall(r"[ぁ-んァ-ヶー]", text)) / max(1, len(re.findall(r"[^\x00-\x7f]", text)))
            half = len(re.findall(r"[ｦ-ﾟ]", text)) / max(1, len(text))
            sure *= min(1.0, 0.6 + kana) * (1 - min(1.0, 3 * half)) if has_japanese(text) else 0.2
        if sure > best.confidence:
            best = Detected(name, min(1.0, sure))
    return best if best.confidence >= least else alternative(data, fallback)


def alternative(data: bytes, fallback: str = "utf-8") -> Detected:
    """The first encoding that leaves little corruption."""
    for name in ENCODINGS:
        try:
            if corruption(decode(data, name)) < 0.1:
                return Detected(name, 0.8)
        except (UnicodeError, LookupError):
            continue
    return Detected(fallback, 0.0)
