"""Regex fragments whose meaning must not depend on the JVM's Unicode rules."""

# Word boundary over ASCII word characters only: the JVM's own one counts accented letters as word
# characters, which would hide a card number that directly follows "é".
EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# Unicode white space, as a class body and as a class.
SPACE_BODY = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
SPACE = f"[{SPACE_BODY}]"
WHITE = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def line_start() -> str:
    """Start of text or just after a line terminator."""
    return r"(?:(?<=[\n\r\u2028\u2029])|\A)"
