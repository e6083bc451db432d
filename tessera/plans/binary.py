"""Binary packing: formats are joined into one struct code and run over batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F

#: Format names, their struct codes and SQL types.
CODES = {
    "boolean": ("?", "boolean"), "byte": ("b", "int"), "unsigned byte": ("B", "int"), "short": (">h", "int"), "unsigned short": (">H", "int"),
    "int": (">i", "int"), "unsigned int": (">I", "long"), "long": (">q", "long"), "float": (">f", "float"), "double": (">d", "double"),
    "<short": ("<h", "int"), "<int": ("<i", "int"), "<long": ("<q", "long"), "<float": ("<f", "float"), "<double": ("<d", "double"),
}


def pack_udf(formats: list[str]):
    codes = [CODES.get(f, (None,))[0] for f in formats]

    @F.pandas_udf("binary")
    def run(rows: pd.DataFrame) -> pd.Series:
        def one(values):
            out = b""
            for f, code, v in zip(formats, codes, values, strict=True):
                if f == "pad":
                    out += b"\0"
                elif f == "raw" or f.startswith("raw"):
                    out += bytes(v)
                elif f.startswith("null"):
                    out += bytes(v) + b"\0"
                elif f.startswith("prefix"):
                    out += bytes([len(v)]) + bytes(v)
                else:
                    out += struct.pack(code, v)
            return out

        return pd.Series([one(r) for r in rows.itertuples(index=False)])

    return run


def unpack_udf(formats: list[str]):
    kinds = ", ".join(f"v{k} {CODES[f][1] if f in CODES else 'binary'}" for k, f in enumerate(formats))

    @F.pandas_udf(f"array<struct<{kinds}>>")
    def run(values: pd.Series) -> pd.Series:
        def one(data):
            out, at = {}, 0
            try:
                for k, f in enumerate(formats):
                    if f in CODES:
                        n = struct.calcsize(CODES[f][0])
                        (out[f"v{k}"],) = struct.unpack(CODES[f][0], data[at : at + n])
                    elif f == "pad":
                        n, out[f"v{k}"] = 1, None
                    elif f.startswith("null"):
                        n = data.index(b"\0", at) + 1 - at
                        out[f"v{k}"] = data[at : at + n - 1]
                    elif f.startswith("prefix"):
                        n = data[at] + 1
                        out[f"v{k}"] = data[at + 1 : at + n]
                    else:
                        n = int(f[3:].strip() or len(data) - at)
                        out[f"v{k}"] = data[at : at + n]
                    at += n
            except (struct.error, ValueError, IndexError):
                return []
            return [out] if at == len(data) else []

        return pd.Series([[] if v is None else one(bytes(v)) for v in values])

    return lambda c: F.get(run(c), F.lit(0))
