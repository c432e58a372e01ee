"""Compare a query with its SQL."""

import pandas as pd
from compare import connect, differences


def sql_gap(query, spark, folder, statement):
    """Difference between a query and its SQL; nulls as None in both."""
    ours = query(spark, folder)
    mine = pd.DataFrame([list(r) for r in ours.collect()], columns=ours.columns, dtype=object)
    result = connect(folder).execute(statement)
    names = [c[0] for c in result.description]
    theirs = pd.DataFrame([list(r) for r in result.fetchall()], columns=names, dtype=object)
    return differences(mine.where(mine.notna(), None), theirs.where(theirs.notna(), None))
