"""Electrode label and path expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: letters of the shaft followed by the contact number.
LABEL_PATTERN = r"^([A-Za-z]+)(\d+)$"


def contact_number(label: Column) -> Column:
    """Contact number of a label such as RMDT1; NULL when the label does not parse."""
    return F.regexp_extract(label, LABEL_PATTERN, 2).try_cast("bigint")


def shaft_name(label: Column) -> Column:
    """Shaft of a label; NULL exactly when the contact number is."""
    return F.when(contact_number(label).isNotNull(), F.regexp_extract(label, LABEL_PATTERN, 1))


def pair_label(anode: Column, cathode: Column) -> Column:
    return F.concat_ws("-", anode, cathode)


def subject_key(subject: Column) -> Column:
    """'sub-259' and '259' both name subject 259."""
    return F.when(subject.startswith("sub-"), F.regexp_replace(subject, "sub-", "")).otherwise(subject)


def result_path(path: Column) -> Column:
    """Where the result of an input file belongs: ../preprocessed/<stem>_bipolar_psd.nwb."""
    return F.regexp_replace(path, r"/[^/]+/([^/]+)\.[^./]+$", "/preprocessed/$1_bipolar_psd.nwb")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)
