"""File formats: how an operator's files are named, cut and renamed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

# The reader options that have an equivalent here.
READER_OPTIONS = {"sep", "encoding", "decimal", "skiprows", "na_values", "quotechar", "comment"}
# Texts that count as missing in a delimited file.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The columns of the second operator's files.
OTHER_RAW_COLUMNS = {
    "timestamp": "time",
    "link_id": "cml_id",
    "sublink": "sublink_id",
    "tx_power": "tsl",
    "rx_power": "rsl",
}
OTHER_METADATA_COLUMNS = {
    "link_id": "cml_id",
    "sublink": "sublink_id",
    "lon_a": "site_0_lon",
    "lat_a": "site_0_lat",
    "lon_b": "site_1_lon",
    "lat_b": "site_1_lat",
    "freq_mhz": "frequency",
    "pol": "polarization",
    "length_km": "length",
}
# Older names of the canonical format.
ALIASES = {"openmrg": "demo_csv_data", "orange_cameroun": "demo_csv_data"}


@dataclass(frozen=True)
class Format:
    """One way of writing files.

    ``parse_raw`` and ``parse_metadata`` replace the built-in parsing of rows;
    each takes a DataFrame of text columns under canonical names and returns one.
    """

    name: str
    sep: str = ","
    encoding: str = "UTF-8"
    decimal: str = "."
    skiprows: int = 0
    na_values: tuple[str, ...] = ()
    quotechar: str = '"'
    comment: str | None = None
    rawdata_columns: dict[str, str] = field(default_factory=dict)
    metadata_columns: dict[str, str] = field(default_factory=dict)
    timezone: str | None = None
    ambiguous: str = "earlier"
    metadata_keyword: str | None = "meta"
    rawdata_keywords: tuple[str, ...] | None = ("raw", "data")
    levels_required: bool = False
    frequency_factor: float = 1.0
    length_factor: float = 1.0
    parse_raw: Callable[[DataFrame], DataFrame] | None = None
    parse_metadata: Callable[[DataFrame], DataFrame] | None = None

    @property
    def utf8(self) -> bool:
        return self.encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")

    @property
    def whole_files(self) -> bool:
        """Whether a file must be read in one piece: to count lines from its top,
        or because its line ends are not single bytes."""
        return bool(self.skiprows) or self.encoding.upper().startswith(("UTF-16", "UTF-32"))


def _canonical(_config: dict) -> Format:
    return Format("demo_csv_data", levels_required=True)


def _other(_config: dict) -> Format:
    return Format("other_mno_csv", sep=";", rawdata_columns=OTHER_RAW_COLUMNS, metadata_columns=OTHER_METADATA_COLUMNS)


def _generic(config: dict) -> Format:
    options = dict(config.get("read_csv_kwargs") or {})
    unknown = set(options) - READER_OPTIONS
    if unknown:
        raise ValueError(f"unsupported reader options: {sorted(unknown)}")
    if isinstance(options.get("na_values"), str):
        options["na_values"] = (options["na_values"],)
    options["na_values"] = tuple(options.get("na_values") or ())
    keyword = config.get("rawdata_filename_keyword")
    return Format(
        "csv_generic",
        **options,
        rawdata_columns=dict(config.get("rawdata_columns") or {}),
        metadata_columns=dict(config.get("metadata_columns") or {}),
        timezone=config.get("timezone"),
        ambiguous=config.get("ambiguous", "earlier"),
        metadata_keyword=config.get("metadata_filename_keyword", "meta"),
        rawdata_keywords=(keyword,) if keyword else None,
        frequency_factor=config.get("frequency_factor", 1.0),
        length_factor=config.get("length_factor", 1.0),
    )


def _json(_config: dict) -> Format:
    return Format("api_json", metadata_keyword=None, rawdata_keywords=(".json",))


#: The keys are fixed values.
_REGISTRY: dict[str, Callable[[dict], Format]] = {
    "demo_csv_data": _canonical,
    "other_mno_csv": _other,
    "csv_generic": _generic,
    "api_json": _json,
}


def register_format(name: str, make: Callable[[dict], Format]) -> None:
    """Add a format of one's own."""
    _REGISTRY[name] = make


def load_format(name: str, config: dict | None = None) -> Format:
    name = ALIASES.get(name, name)
    if name not in _REGISTRY:
        raise ValueError(f"Unknown parser_type: {name!r}")
    return _REGISTRY[name](config or {})


def with_parsers(base: Format, parse_raw=None, parse_metadata=None) -> Format:
    return replace(base, parse_raw=parse_raw, parse_metadata=parse_metadata)
