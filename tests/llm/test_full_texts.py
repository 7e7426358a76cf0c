"""The full licences of op10: a text that is not there is told, not taken for a licence that no document has."""

import pytest

from glossweave.llm import licenses


def test_they_come_with_the_package(monkeypatch):
    real = licenses.Path.is_file
    monkeypatch.setattr(licenses.Path, "is_file", lambda self: "/usr/share" not in str(self) and real(self))
    found = licenses.full_texts()
    assert [name for name, _ in found] == list(licenses.FILES.values())
    assert all(len(licenses.bigrams(t)) > 500 for _, t in found)


def test_a_missing_text_is_an_error(tmp_path):
    for f in list(licenses.FILES)[:-1]:
        (tmp_path / f).write_text("one two three")
    with pytest.raises(FileNotFoundError, match="MPL-2.0"):
        licenses.full_texts(str(tmp_path))
    with pytest.raises(FileNotFoundError, match="Apache-2.0, Artistic"):
        licenses.full_texts(str(tmp_path / "nowhere"))
