"""Common words of the four languages, used as histogram bins and as anchors.

Fixed values: function words from public frequency lists, about thirty of each language.
"""

COMMON = {
    "en": "the of and to a in is that it was for on are as with his they at be this from have or by not but",
    "de": "der die das und in zu den ist von mit nicht ein eine auf für dem des im sich sie er als auch an es",
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas sur au avec ce il ne se",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero",
}

#: In first-seen order, each once, as UTF-8.
WORDS = list(dict.fromkeys(w.encode() for text in COMMON.values() for w in text.split()))

# ASCII capitals become small; every ASCII character that is no letter or digit becomes a blank.
_FOLD = bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in range(256)).lower()
# capitals À-Þ (UTF-8 C3 80 - C3 9E) fold to à-þ by one bit of the second byte
_CAPITALS = [(bytes([0xC3, c]), bytes([0xC3, c + 0x20])) for c in range(0x80, 0x9F) if c != 0x97]


def folded(text: bytes) -> list[bytes]:
    """Words in small letters, cut at blanks and ASCII punctuation."""
    text = text.translate(_FOLD)
    if not text.isascii():
        for a, b in _CAPITALS:
            if a in text:
                text = text.replace(a, b)
    return text.split()
