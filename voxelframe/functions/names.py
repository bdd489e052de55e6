"""Names, paths and labels as column expressions."""

from __future__ import annotations

import re
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords in channel names and the colours shown for them, in the order they are tried.
COLOR_KEYWORDS = {
    "lime": ["Green", "GFP", "FITC", "mNeon"],
    "magenta": ["Magenta", "TXR", "RFP", "mScarlet", "mCherry"],
    "blue": ["Blue", "DAPI", "BFP", "Hoechst"],
    "red": ["Red"],
    "yellow": ["Yellow", "Cy3"],
    "orange": ["Orange", "Cy5", "Y5"],
}

# CSS colour names used for display.
COLOR_HEX = {"lime": "00FF00", "magenta": "FF00FF", "blue": "0000FF", "red": "FF0000", "yellow": "FFFF00", "orange": "FFA500", "white": "FFFFFF"}

# Display window (start, end, min, max) by channel name, and for all others.
WINDOWS = {
    "Retardance": (0.0, 100.0, 0.0, 1000.0),
    "Orientation": (0.0, 3.141592653589793, 0.0, 3.141592653589793),
    "Phase2D": (-0.2, 0.2, -10.0, 10.0),
    "Phase3D": (-0.2, 0.2, -10.0, 10.0),
    "BF": (0.0, 5.0, 0.0, 65535.0),
    "S0": (0.0, 1.0, 0.0, 65535.0),
    "S1": (-0.5, 0.5, -10.0, 10.0),
    "S2": (-0.5, 0.5, -10.0, 10.0),
    "S3": (-1.0, 1.0, -10.0, -10.0),
}
OTHER_WINDOW = (0.0, 65535.0, 0.0, 65535.0)


def color_hex(name: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(COLOR_HEX.items())]), name)


def channel_color(channel: Column) -> Column:
    """The colour of the first keyword that the name holds; white without one."""
    out = None
    for color, words in COLOR_KEYWORDS.items():
        hit = F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(channel, w))
        out = F.when(hit, COLOR_HEX[color]) if out is None else out.when(hit, COLOR_HEX[color])
    return out.otherwise(COLOR_HEX["white"])


def display_window(channel: Column) -> Column:
    """struct(start, end, min, max) for a channel name."""
    fields = ("start", "end", "min", "max")
    struct = lambda v: F.struct(*[F.lit(x).alias(f) for f, x in zip(fields, v, strict=True)])
    known = F.create_map(*chain.from_iterable((F.lit(k), struct(v)) for k, v in WINDOWS.items()))
    return F.coalesce(F.try_element_at(known, channel), struct(OTHER_WINDOW))


def well_label(label: Column) -> Column:
    """struct(row, column, field) of a plate acquisition's position label; null for labels of no known kind.

    A label is parted at dashes and underscores, each of which has its place. The second part tells
    the kind: ``-Site_`` comes after a row letter and a column number, a grid position ``-Pos<n>``
    after a column number, ``_`` before a second number; a label that begins with ``Pos-`` goes on
    with the column, ``-`` and two numbers with ``_`` between. Where there are no row letters the
    row is 0, and a field of two numbers is both of them, the second 000 if left out.
    """
    signs = F.regexp_replace(label, "[^-_]", "")
    parts = F.split(label, "[-_]")
    part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    digits = lambda text: F.regexp_extract(text, "^[0-9]*", 0)
    made = lambda row, column, field: F.struct(row.alias("row"), column.alias("column"), field.alias("field"))
    number = lambda text: text.rlike("^[0-9]+$")
    letter, column = F.left(part(1), F.lit(1)), F.substr(part(1), F.lit(2))
    site = (part(2) == "Site") & letter.between("A", "Z") & number(column) & (digits(part(3)) != "") & F.startswith(signs, F.lit("-_"))
    grid = F.startswith(part(2), F.lit("Pos")) & number(part(1)) & (digits(F.substr(part(2), F.lit(4))) != "") & F.startswith(signs, F.lit("-"))
    stage = (part(1) == "Pos") & number(part(2)) & number(part(3)) & (digits(part(4)) != "") & F.startswith(signs, F.lit("--_"))
    # A second number only goes on where the first one ended.
    whole = part(2).rlike("^Pos[0-9]+$") & F.startswith(signs, F.lit("-_"))
    second = F.when(whole & (digits(part(3)) != ""), digits(part(3))).otherwise("000")
    return (
        F.when(site, made(letter, column, digits(part(3))))
        .when(stage, made(F.lit("0"), part(2), F.concat(part(3), digits(part(4)))))
        .when(grid, made(F.lit("0"), part(1), F.concat(digits(F.substr(part(2), F.lit(4))), second)))
    )


def normal_path(path: Column) -> Column:
    """Forward slashes, no empty or ``.`` parts; null where a part is ``..``."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    return F.when(~F.array_contains(parts, ".."), F.array_join(parts, "/"))


def plane_key(key: Column) -> Column:
    """A sort key of metadata keys: those with a dash come after all others."""
    return F.struct(F.contains(key, F.lit("-")).alias("dashed"), key.alias("key"))


def channel_name(name: Column, index: Column) -> Column:
    """A channel's name, or its number where it has none."""
    return F.coalesce(name, index.cast("string"))


def valid_name(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}]+$")


def valid_well_path(path: Column) -> Column:
    return path.rlike(r"^\w+/\w+$")


def size_text(n: Column, largest: str | None = None) -> Column:
    """Bytes for reading, one decimal, halves to the even one; null from 1024 TiB on.

    With ``largest`` (KiB, MiB, GiB or TiB) no greater unit is taken, whatever the number.
    """
    units = ("KiB", "MiB", "GiB", "TiB")
    out = F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for k, unit in enumerate(units if largest is None else units[: units.index(largest) + 1], 1):
        value = n / 1024.0**k
        out = out.when((value < 1024) | F.lit(unit == largest), F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(f" {unit}")))
    return out


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits, of any length, order by their number."""

    def ordered(part: Column) -> Column:
        number = F.ltrim(part, F.lit("0"))
        # The number of digits comes first, itself at a fixed width.
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(number).cast("string"), 9, "0"), number)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1), ordered), "\x01")


def glob_pattern(glob: str) -> str:
    """A shell glob as an anchored regular expression."""
    out, k = "", 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if end > 0:
            inner = glob[k + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def matches_any(name: Column, globs: list[str], reserved: tuple[str, ...] = ()) -> Column:
    """Whether a name matches one of the globs and isn't reserved."""
    hit = F.lit(False)
    for g in globs:
        hit = hit | name.rlike(glob_pattern(g))
    return hit & ~name.isin(*reserved) if reserved else hit


def label_rgba(color: Column) -> Column:
    """RGB or RGBA of 0 to 255 as RGBA of 0 to 1; null where a part is out of range."""
    color = F.transform(color, lambda v: v.cast("double"))
    full = F.when(F.size(color) == 3, F.concat(color, F.array(F.lit(255.0)))).otherwise(color)
    fine = F.forall(full, lambda v: (v >= 0) & (v <= 255))
    return F.when(fine, F.transform(full, lambda v: v / 255.0))


def index_line(line: Column) -> Column:
    """Sizes that the last line of an acquisition index tells: struct(t, z, y, x).

    Its fields, parted by tabs and commas, are the time point, the seconds, and the sizes x, y, z.
    """
    fields = F.split(line, "[\t,]")
    at = lambda k: F.trim(F.try_element_at(fields, F.lit(k + 1))).try_cast("long")
    return F.struct(at(0).alias("t"), at(4).alias("z"), at(3).alias("y"), at(2).alias("x"))
