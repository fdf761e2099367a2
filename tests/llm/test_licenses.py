"""License notices inside sentences and long lines."""

import pytest

from vecstrata.llm.licenses import TEMPLATES, Scanner


@pytest.mark.parametrize(
    "text, names",
    [
        ("Except where noted, content on this site is licensed under CC BY 4.0 and may be reused.", ["CC-BY-notice"]),
        ("This article by Jane Doe, first published in 2020, is licensed under CC BY 4.0.", ["CC-BY-notice"]),
        ("Text and photographs on these pages are licensed under CC BY-SA 4.0 by their authors.", ["CC-BY-SA-notice"]),
        ("Licensed content of all kinds, sounds and films, is licensed under CC BY-NC 4.0 here", ["CC-BY-NC-notice"]),
        ("The code is released under the MIT License and the text is licensed under CC BY 4.0.", ["CC-BY-notice", "MIT-notice"]),
        ("word " * 900 + "licensed under the Apache License, Version 2.0 " + "word " * 900, ["Apache-notice"]),
    ],
)
def test_notices_inside_other_text(text, names):
    assert sorted(h[2] for h in Scanner().scan(text.encode())) == names


def test_every_notice_inside_a_long_line():
    s = Scanner()
    for name, text in TEMPLATES.items():
        if name != "CC0-text":
            inside = "lorem ipsum " * 60 + text.replace("{v}", "2.0").replace("{y}", "2020 Foo").rstrip(".") + " dolor sit" * 60
            assert name in [h[2] for h in s.scan(inside.encode())], name
