"""Conversions as Columns: enums, byte strings, unsigned numbers, bits, names, escapes, number texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default fill values of the public NetCDF conventions, by type (fixed values).
FILL = {
    "byte": -127, "ubyte": 255, "char": 0, "short": -32767, "ushort": 65535, "int": -2147483647, "uint": 4294967295,
    "int64": -9223372036854775806, "uint64": 18446744073709551614, "float": 9.969209968386869e36, "double": 9.969209968386869e36, "string": "",
}
FILL_SD = FILL | {"ubyte": 129, "ushort": 32769, "uint": 2147483649, "uint64": 9223372036854775810}

# Prefixes of metadata objects of the EOS profiles (fixed values).
EOS_METADATA = ("archivemetadata", "coremetadata", "productmetadata", "structmetadata", "oldstructmetadata", "gridstructure", "pointstructure", "swathstructure")

# Attributes that the NetCDF-4 library keeps for itself (fixed values).
HIDDEN_ATTRIBUTES = ("_NCProperties", "_Netcdf4Coordinates", "_Netcdf4Dimid", "_nc3_strict", "CLASS", "NAME", "DIMENSION_LIST", "REFERENCE_LIST", "DIMENSION_LABELS")
NOT_A_VARIABLE = "This is a netCDF dimension but not a netCDF variable"
NON_COORD = "_nc4_non_coord_"

UNSIGNED = {"byte": "ubyte", "short": "ushort", "int": "uint", "int64": "uint64"}


def with_signedness(name: str, signed: bool) -> str:
    """The integral type of the same size with or without a sign; other types are unchanged."""
    back = {v: k for k, v in UNSIGNED.items()}
    return back.get(name, name) if signed else UNSIGNED.get(name, name)


def convert_enums(code: Column, names: dict[int, str]) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in names.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(table, code), F.concat(F.lit("Unknown enum number="), code.cast("string")))


def string_z(text: Column) -> Column:
    """Text up to the first NUL."""
    return F.substring_index(text, "\0", 1)


def bytes_to_string(data: Column) -> Column:
    """An array of unsigned byte values as UTF-8 text up to the first NUL."""
    return string_z(F.decode(F.unhex(F.array_join(F.transform(data, lambda b: F.lpad(F.hex(b), 2, "0")), "")), "UTF-8"))


def unsigned(value: Column, bits: int) -> Column:
    """The unsigned reading of a signed number of so many bits."""
    if bits < 64:
        return value.cast("long").bitwiseAND((1 << bits) - 1)
    return (value.cast("decimal(20,0)") + F.when(value < 0, F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(F.lit(0))).cast("decimal(20,0)")


def log2_floor(n: Column) -> Column:
    return (F.length(F.bin(n)) - 1).cast("long")


def bit_set(n: Column, bit: Column | int) -> Column:
    return F.shiftrightunsigned(n, bit).bitwiseAND(1) == 1 if isinstance(bit, int) else F.getbit(n, bit) == 1


def padding(n: Column, multiple: int = 4) -> Column:
    return F.pmod(-n, F.lit(multiple))


def tag_id(code: Column, ref: Column) -> Column:
    return F.shiftleft(code.cast("long").bitwiseAND(0x3FFF), 16) + ref.cast("long").bitwiseAND(0xFFFF)


def little_endian(data: Column) -> Column:
    """Unsigned number of an array of byte values, lowest first."""
    return F.aggregate(F.reverse(data), F.lit(0).cast("long"), lambda a, b: a * 256 + b)


def unshuffle(data: Column, width: int) -> Column:
    """Undo a byte shuffle: planes of equal bytes back to elements of `width` bytes."""
    m = F.floor(F.size(data) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), m * width - 1), lambda i: F.get(data, (i % width) * m + F.floor(i / width).cast("int")))


def valid_name(name: Column) -> Column:
    """Trimmed of characters up to space; slashes, spaces and commas become underscores, control characters go."""
    trimmed = F.regexp_replace(name, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(F.translate(trimmed, "/ ,", "___"), r"[\x00-\x1f]", "")


def backslash_escape(name: Column) -> Column:
    return F.regexp_replace(name, r"([.\\])", r"\\$1")


def backslash_unescape(name: Column) -> Column:
    return F.regexp_replace(name, r"\\(.)", "$1")


def escape_cdl(text: Column) -> Column:
    """Escapes for quoted text, one kind after the other; each only if the text as given has it."""
    out = text
    for c, to in (("\b", "\\b"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\\\\"), ("'", "\\'"), ('"', '\\"')):
        out = F.when(F.contains(text, F.lit(c)), F.replace(out, F.lit(c), F.lit(to))).otherwise(out)
    return out


def hex_text(data: Column) -> Column:
    return F.concat(F.lit("0X"), F.hex(data))


def is_eos_metadata(name: Column) -> Column:
    return F.lower(name).rlike("^(" + "|".join(EOS_METADATA) + ")")


def sig_fig(value: Column, digits: int = 3) -> Column:
    """Number text with so many significant digits; the fraction is cut, not rounded."""
    text = value.cast("decimal(30,10)").cast("string")
    whole, rest = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    count = F.length(F.regexp_replace(whole, "^-?0*", ""))
    need = F.greatest(F.lit(digits) - count, F.lit(0))
    return F.when(need == 0, whole).otherwise(F.concat(whole, F.lit("."), F.substring(rest, F.lit(1), need)))


def mode_text(mode: Column) -> Column:
    """Names of the mode bits of an open file, in bit order, each followed by a space (fixed values of the public API)."""
    bits = (
        (1, "NC_WRITE"), (8, "NC_DISKLESS"), (16, "NC_MMAP"), (32, "NC_64BIT_DATA"), (64, "NC_UDF0"), (128, "NC_UDF1"), (0x100, "NC_CLASSIC_MODEL"),
        (0x200, "NC_64BIT_OFFSET"), (0x1000, "NC_NETCDF4"), (0x20000, "NC_NOATTCREORD"), (0x40000, "NC_NODIMSCALE_ATTACH"),
    )
    return F.concat(*[F.when(mode.bitwiseAND(b) != 0, f"{n} ").otherwise("") for b, n in bits])
