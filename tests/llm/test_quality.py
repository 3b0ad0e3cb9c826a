"""Line rules in proportion to the line."""

from formweave.llm import quality



def prose(i: int) -> bytes:
    """Words that no other line has."""
    return b" ".join(b"%s%d" % (w, i) for w in b"the quiet river ran past old stone houses where people had lived for many long years".split())


def verdict(text: bytes):
    (row,) = quality.judged([text])
    return row[6], row[7]


def test_long_lines_of_prose_do_not_fail_for_a_phrase():
    line = b" ".join(map(prose, range(9)))
    for tail in (b" as the privacy policy says.", b" and so on!! truly!! yes!!"):
        kept, cleaned = verdict(line + tail)
        assert kept and cleaned == line + tail


def test_short_lines_fail():
    body = b"\n".join(map(prose, range(5)))
    for bad in (b"Read our Privacy Policy here", b"Buy!! now!! cheap!!", b"Home | News | Sport | More", b"$$$ # win", b"ALL CAPS LINE"):
        kept, cleaned = verdict(body + b"\n" + bad)
        assert kept and cleaned == body
    assert quality.line_fails(b"click here " + b"w " * 13, 15) and not quality.line_fails(b"click here " + b"w " * 14, 16)


def test_repeated_rows_and_long_single_lines():
    long = b" ".join(b"word%d" % i for i in range(50_000))
    assert quality.judged([long, long, b""]) == [*[(50_000, len(long.replace(b" ", b"")), 0, 0, 0, False, True, long)] * 2, (0, 0, 0, 0, 0, True, False, b"")]
