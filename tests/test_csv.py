from __future__ import annotations

import pytest

from vignette.sources import files

ODD = ["a", " lead", "trail ", "\ttab", "\n\nlines\n", "\r\ncr", "a\rb", " ", "\n", "\r", "\x01a\x01", "\x0c", "\0", 'a"\0b', '"', 'a\\"b', '","\n', 'a"\n', "x,y", "#c", "é\u0085"]


@pytest.mark.parametrize("texts", [ODD, *[[x] for x in (" lead", "\r\ncr", 'a"\n')]])
def test_texts_come_back_as_they_were(spark, tmp_path, texts):
    """blanks, line breaks and control characters at the ends of a text were trimmed when it was written."""
    want = [(i, x, ' s,"1" ') for i, x in enumerate(texts)]
    files.write_csv(spark.createDataFrame(want, "doc_id bigint, text string, source string").coalesce(1), str(tmp_path / "csv"))
    got = files.read_csv(spark, str(tmp_path / "csv"), "doc_id bigint, text string, source string").collect()
    assert sorted(map(tuple, got)) == want
