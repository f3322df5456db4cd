"""Scalar functions as Column expressions: sizes, names, modes and little-endian numbers. All stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIB = 1 << 20


def block_size_for_level(level: Column) -> Column:
    """Bytes in a block at a level; a level outside 0 to 9 takes 16 MiB."""
    size = F.when(level.between(0, 1), 1).when(level == 2, 4).when(level == 3, 16).when(level.between(4, 5), 32).when(level.between(6, 9), 64).otherwise(16)
    return size.cast("long") * MIB


def default_level(level: Column, mode: Column) -> Column:
    """The level asked for, else 19 for the fast mode and 3 for the others."""
    return F.coalesce(level, F.when(mode == "fast", 19).otherwise(3))


def mode_for_flags(fast: Column, ratio: Column) -> Column:
    """fast wins over ratio; neither is balanced."""
    return F.when(fast, "fast").when(ratio, "ratio").otherwise("balanced")


def format_bytes(n: Column) -> Column:
    """A size as B, KB, MB or GB with two decimals, ties to even, above 1,023 bytes; a unit is 1,024 of the one before."""
    scaled = lambda k, unit: F.format_string(f"%.2f {unit}", F.bround(n.cast("double") / float(1024**k), 2))
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def format_bytes_short(n: Column) -> Column:
    """As ``format_bytes`` with TB, and without trailing zeros."""
    trim = lambda c: F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    scaled = lambda k, unit: F.concat(trim(F.format_string("%.2f", F.bround(n.cast("double") / float(1024**k), 2))), F.lit(f" {unit}"))
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = out.when(n < 1024 ** (k + 1), scaled(k, unit))
    return out.otherwise(scaled(4, "TB"))


def basename(path: Column) -> Column:
    """What stands after the last slash."""
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """What stands before the last slash; the root for names right under it, empty without a slash."""
    return F.when(path.rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract(path, "^(.*)/[^/]*$", 1))


def compressed_name(path: Column) -> Column:
    """The archive's default name."""
    return F.concat(path, F.lit(".ctx"))


def is_volume(path: Column) -> Column:
    """Whether a name ends as a volume's: a dot and exactly three digits."""
    return path.rlike(r"\.[0-9]{3}$")


def volume_base(path: Column) -> Column:
    """The name of a volume set: a volume's ending is dropped."""
    return F.regexp_replace(path, r"\.[0-9]{3}$", "")


def restored_name(path: Column) -> Column:
    """The default name of what an archive holds: without volume ending and ``.ctx``, or else with ``.out``."""
    base = volume_base(path)
    return F.when(base.endswith(".ctx"), F.regexp_replace(base, r"\.ctx$", "")).otherwise(F.concat(base, F.lit(".out")))


def restored_folder(path: Column) -> Column:
    """The default name of the folder that an archive's members go to."""
    return F.concat(F.regexp_replace(volume_base(path), r"\.ctx$", ""), F.lit("_restored"))


def is_flag(argument: Column) -> Column:
    """Whether a command's argument is an option and no path."""
    return argument.startswith("-")


def can_extract(selected: Column, is_dir: Column, name: Column) -> Column:
    """Whether an item may be extracted: selected, no folder, and an archive or a volume of one."""
    return selected & ~is_dir & (name.endswith(".ctx") | name.rlike(r"\.ctx\.[0-9]{3}$"))


def item_type(name: Column, is_dir: Column) -> Column:
    """Folder, Archive or File."""
    return F.when(is_dir, "Folder").when(name.endswith(".ctx"), "Archive").otherwise("File")


def is_hidden(name: Column) -> Column:
    """Whether a name starts with a dot."""
    return name.startswith(".")


def split_bytes(megabytes: Column) -> Column:
    """Bytes in a volume of so many MiB, at most the largest long."""
    most = (1 << 63) - 1
    return F.when(megabytes > most // MIB, F.lit(most)).otherwise(megabytes.cast("long") * MIB)


def le_hex(n: Column, width: int) -> Column:
    """A number's ``width`` low bytes, lowest first, as hex."""
    big = F.lpad(F.hex(n), 16, "0")
    return F.concat(*[F.substring(big, 15 - 2 * i, 2) for i in range(width)])


def le_bytes(n: Column, width: int) -> Column:
    """A number as ``width`` little-endian bytes."""
    return F.unhex(le_hex(n, width))


def le_number(data: Column, at: int, width: int) -> Column:
    """The little-endian number of ``width`` bytes (8 at most) at an offset; null from 2 to the 63rd on."""
    h = F.hex(F.substring(data, at + 1, width))
    return F.conv(F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(width))]), 16, 10).try_cast("long")


def be_bytes(n: Column, width: int = 8) -> Column:
    """A number as big-endian bytes."""
    return F.unhex(F.substring(F.lpad(F.hex(n), 16, "0"), 17 - 2 * width, 2 * width))


def ratio_percent(output: Column, source: Column) -> Column:
    """Output as a percentage of the input; an empty input counts as one byte."""
    return output.cast("double") * 100.0 / F.greatest(source, F.lit(1)).cast("double")


def megabytes_per_second(n: Column, seconds: Column) -> Column:
    """Decimal megabytes in a second; null without time."""
    return F.when(seconds > 0, n.cast("double") / 1e6 / seconds)
