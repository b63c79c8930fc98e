"""One local session for all tests; small fixtures are made here or in the tests."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from citeloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "3g", 4, "citeloom-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


PAPER = (
    "canonical_id string, title string, abstract string, year int, venue string, domain string, doi string, arxiv_id string, semantic_scholar_id string, openalex_id string, "
    "authors array<struct<name:string,orcid:string>>, references array<string>, "
    "provenance array<struct<source:string,source_id:string,fetched_at:timestamp_ntz,field_confidence:map<string,string>,raw:string>>, pos long"
)


def paper(canonical_id, pos=0, **kw):
    """A row of the papers table; what is not given is null."""
    names = [c.split(" ")[0] for c in PAPER.replace("array<struct<name:string,orcid:string>>", "x").replace("array<struct<source:string,source_id:string,fetched_at:timestamp_ntz,field_confidence:map<string,string>,raw:string>>", "x").split(", ")]
    row = dict.fromkeys(names) | {"canonical_id": canonical_id, "pos": pos} | kw
    return tuple(row[n] for n in names)


@pytest.fixture(scope="session")
def papers(spark):
    return lambda rows: spark.createDataFrame(rows, PAPER)
