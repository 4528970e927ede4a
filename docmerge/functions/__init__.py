"""Column functions."""

from docmerge.functions.jsontext import compact_json, is_json_object, json_items, json_pairs, loose_pairs, number_text, pairs_to_json
from docmerge.functions.keys import (
    clean_key_suffix,
    is_hidden_key,
    is_joined_header_key,
    is_structure_key,
    is_valid_key,
    nfkc,
    normalize_key,
    strip_leading_punct,
)
from docmerge.functions.names import (
    file_ext,
    group_id_of_row,
    group_key,
    pivot_name,
    repair_filename,
    strip_row_suffix,
)
from docmerge.functions.salvage import parse_json_response
from docmerge.functions.urls import host_of, is_data_url, is_private_host, strip_data_url, to_data_url
from docmerge.functions.values import csv_field, infer_type, normalize_value, render_value

__all__ = [name for name in dir() if not name.startswith("_")]
