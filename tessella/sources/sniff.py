"""File formats by content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of the formats.
MAGIC = (("netcdf3", b"CDF\x01"), ("netcdf3.2", b"CDF\x02"), ("netcdf3.5", b"CDF\x05"), ("hdf5", b"\x89HDF\r\n\x1a\n"), ("hdf4", b"\x0e\x03\x13\x01"))
SEARCH_BYTES = 500_000


def sniff(path: str) -> tuple[str, int] | None:
    """(format, offset of the magic). Classic files start with it; HDF files may have it at 0, 512, 1024, 2048, ..."""
    with open(path, "rb") as f:
        head = f.read(8)
        for name, magic in MAGIC[:3]:
            if head.startswith(magic):
                return name, 0
        at = 0
        while at < SEARCH_BYTES:
            f.seek(at)
            head = f.read(8)
            for name, magic in MAGIC[3:]:
                if head.startswith(magic):
                    return name, at
            if len(head) < 8:
                break
            at = at * 2 if at else 512
    return None


def format_column(content: Column) -> Column:
    """The format of binary content that starts at byte 0; null if unknown."""
    out = F.lit(None).cast("string")
    for name, magic in reversed(MAGIC):
        out = F.when(F.substring(F.hex(content), 1, 2 * len(magic)) == magic.hex().upper(), name).otherwise(out)
    return out


# Format numbers of the public C interface.
FORMATS = {0: "INVALID", 1: "NC_FORMAT_CLASSIC", 2: "NC_FORMAT_64BIT_OFFSET", 3: "NC_FORMAT_NETCDF4", 4: "NC_FORMAT_NETCDF4_CLASSIC", 5: "NC_FORMAT_64BIT_DATA"}
EXTENDED = {0: "NC_FORMATX_UNDEFINED", 1: "NC_FORMATX_NC3", 2: "NC_FORMATX_NC_HDF5", 3: "NC_FORMATX_NC_HDF4", 4: "NC_FORMATX_PNETCDF", 5: "NC_FORMATX_DAP2", 6: "NC_FORMATX_DAP4", 8: "NC_FORMATX_UDF0", 9: "NC_FORMATX_UDF1", 10: "NC_FORMATX_NCZARR"}


def format_name(number: int) -> str:
    if number not in FORMATS:
        raise ValueError(f"unknown format {number}")
    return FORMATS[number]


def extended_name(number: int) -> str:
    if number not in EXTENDED:
        raise ValueError(f"unknown extended format {number}")
    return EXTENDED[number]


def is_classic(name: str) -> bool:
    """Any of the classic binary formats."""
    return name in ("NC_FORMAT_CLASSIC", "NC_FORMAT_64BIT_OFFSET", "NC_FORMAT_64BIT_DATA")


def is_netcdf4(name: str) -> bool:
    return name in ("NC_FORMAT_NETCDF4", "NC_FORMAT_NETCDF4_CLASSIC")


def is_extended_model(name: str) -> bool:
    """Groups and user types are possible."""
    return name == "NC_FORMAT_NETCDF4"


def is_large_file(name: str) -> bool:
    return name == "NC_FORMAT_64BIT_OFFSET"


def is_classic_model(name: str) -> bool:
    return name in ("NC_FORMAT_CLASSIC", "NC_FORMAT_64BIT_OFFSET", "NC_FORMAT_NETCDF4_CLASSIC", "NC_FORMAT_64BIT_DATA")
