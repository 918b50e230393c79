"""Languages: which files they own and what they extract. Register more with `register`."""

from trellis.lang.base import EXTENSIONS, LANGUAGES, LanguageSpec, detect, register
from trellis.lang import braces, python, ruby  # noqa: F401  they register themselves

#: The order in which languages are listed.
ORDER = ("go", "python", "java", "csharp", "typescript", "rust", "kotlin", "ruby", "php", "c")


def names() -> list[str]:
    """Registered languages; ones added later follow the built-in ones."""
    return [n for n in ORDER if n in LANGUAGES] + [n for n in LANGUAGES if n not in ORDER]


__all__ = ["EXTENSIONS", "LANGUAGES", "LanguageSpec", "ORDER", "braces", "detect", "names", "python", "register", "ruby"]
