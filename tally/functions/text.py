"""String splitting and stripping with literal (not regex) delimiters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading/trailing whitespace as Python's str.strip() sees it: every Unicode
# White_Space character (no-break space, em space, ...) plus the four ASCII
# information separators 0x1C-0x1F.
_WS = r"[\s\x1C-\x1F]"
_STRIP_PATTERN = rf"(?U)^{_WS}+|{_WS}+$"


def regex_literal(text: str) -> str:
    """Java-regex pattern that matches ``text`` literally."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_literal(c: Column | str, delimiter: str = ",") -> Column:
    """Split on a literal delimiter; empty pieces (also trailing ones) are kept."""
    c = F.col(c) if isinstance(c, str) else c
    return F.split(c, regex_literal(delimiter), -1)


def strip_whitespace(c: Column | str) -> Column:
    """Remove leading and trailing Unicode whitespace."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, _STRIP_PATTERN, "")
