"""Every query of the library by name, with its SQL where there is one."""

from __future__ import annotations

from tidewire.plans import curation, landings, relations, scalars


def queries():
    return {**scalars.QUERIES, **relations.QUERIES, **curation.QUERIES, **landings.QUERIES}


def oracle_sql():
    return {**scalars.SQL, **relations.SQL, **curation.SQL, **landings.SQL}


def flagship(spark, sf_dir):
    return relations.curated_top(spark, sf_dir)
