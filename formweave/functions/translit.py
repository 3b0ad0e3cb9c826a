"""Latin text in other scripts: a greedy scan by the longest key, for use in pandas UDFs."""

from __future__ import annotations

#: Latin keys and their letters.
RUSSIAN = {"shch": "щ", "zh": "ж", "kh": "х", "ts": "ц", "ch": "ч", "sh": "ш", "yu": "ю", "ya": "я", "yo": "ё", "a": "а", "b": "б", "c": "к", "d": "д", "e": "е", "f": "ф", "g": "г", "h": "х", "i": "и", "j": "й", "k": "к", "l": "л", "m": "м", "n": "н", "o": "о", "p": "п", "q": "к", "r": "р", "s": "с", "t": "т", "u": "у", "v": "в", "w": "в", "x": "кс", "y": "ы", "z": "з"}
ARABIC = {"kh": "خ", "sh": "ش", "th": "ث", "dh": "ذ", "gh": "غ", "a": "ا", "b": "ب", "c": "ك", "d": "د", "e": "ي", "f": "ف", "g": "ج", "h": "ه", "i": "ي", "j": "ج", "k": "ك", "l": "ل", "m": "م", "n": "ن", "o": "و", "p": "ب", "q": "ق", "r": "ر", "s": "س", "t": "ت", "u": "و", "v": "ف", "w": "و", "x": "كس", "y": "ي", "z": "ز"}
HINDI_CONSONANTS = {"ksh": "क्ष", "chh": "छ", "shh": "ष", "gy": "ज्ञ", "ng": "ङ", "kh": "ख", "gh": "घ", "ch": "च", "jh": "झ", "th": "थ", "dh": "ध", "ph": "फ", "bh": "भ", "sh": "श", "k": "क", "g": "ग", "c": "क", "j": "ज", "t": "त", "d": "द", "n": "न", "p": "प", "b": "ब", "m": "म", "y": "य", "r": "र", "l": "ल", "v": "व", "w": "व", "s": "स", "h": "ह", "f": "फ़", "q": "क", "x": "क्स", "z": "ज़"}
#: A vowel's letter where it stands alone, and its sign after a consonant.
HINDI_VOWELS = {"aa": ("आ", "ा"), "ee": ("ई", "ी"), "ii": ("ई", "ी"), "oo": ("ऊ", "ू"), "uu": ("ऊ", "ू"), "ai": ("ऐ", "ै"), "au": ("औ", "ौ"), "a": ("अ", ""), "i": ("इ", "ि"), "u": ("उ", "ु"), "e": ("ए", "े"), "o": ("ओ", "ो")}
VIRAMA = "्"


def _longest(text: str, at: int, *tables: dict) -> tuple[str, dict] | None:
    for n in (4, 3, 2, 1):
        for t in tables:
            if (key := text[at : at + n]) in t and len(key) == n:
                return key, t
    return None


def to_script(text: str | None, lang: str) -> str | None:
    """`text` in the script of ru, hi or ar, in small letters; other languages, and letters without a key, stay as they are."""
    if not text or lang not in ("ru", "hi", "ar"):
        return text
    low, out, at, bare = text.lower(), [], 0, False
    tables = {"ru": (RUSSIAN,), "ar": (ARABIC,), "hi": (HINDI_CONSONANTS, HINDI_VOWELS)}[lang]
    zero = {"hi": 0x0966, "ar": 0x0660}.get(lang)
    while at < len(low):
        found = _longest(low, at, *tables)
        if not found:
            c = text[at]
            out.append(chr(zero + int(c)) if zero and c.isascii() and c.isdigit() else c)
            at, bare = at + 1, False
            continue
        key, table = found
        if lang == "hi":
            if table is HINDI_VOWELS:
                out.append(table[key][1 if bare else 0])
                bare = False
            else:
                out.append((VIRAMA if bare else "") + table[key])
                bare = True
        else:
            out.append(table[key])
        at += len(key)
    return "".join(out)
