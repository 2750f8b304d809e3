"""Short texts of pages without an article or main element."""

import pytest


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div><p>Roses are red.</p><p>Violets are blue.</p></div><div class='footer'>no</div>", "Roses are red.\nViolets are blue."),
        ("<p>" + "story " * 40 + "</p><div class='ad'><p>buy</p><p>this</p><p>now</p><p>!</p></div><p>The end.</p>", " ".join(["story"] * 40) + "\nThe end."),
        ("<p>Start.</p><div class='ad'><p>a</p><p>b</p><p>c</p></div><p>" + "story " * 40 + "</p>", "Start.\n" + " ".join(["story"] * 40)),
        ("<p>" + "story " * 40 + "</p>" + "<p><a href=x>link</a></p>" * 3 + "<p>Imprint</p>", " ".join(["story"] * 40)),
    ],
)
def test_unmarked(page, text):
    from weftline.llm.html import main_text

    assert main_text(page) == text
