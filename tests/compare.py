"""Rows of a query and of its SQL, made comparable."""


def norm(value):
    if value is None or value != value:
        return "None"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def rows_of(spark_df):
    names = sorted(spark_df.columns)
    return names, sorted(tuple(norm(r[c]) for c in names) for r in spark_df.collect())


def rows_of_sql(duck, sql):
    found = duck.sql(sql)
    names = sorted(found.columns)
    order = [found.columns.index(c) for c in names]
    return names, sorted(tuple(norm(r[i]) for i in order) for r in found.fetchall())
