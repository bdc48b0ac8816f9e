from __future__ import annotations

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts):
    """documents with these texts; pairs give their own id."""
    rows = [x if isinstance(x, tuple) else (i, x) for i, x in enumerate(texts)]
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in rows], DOC)


def clash(df, *names):
    """df with further columns of names that operators might use inside."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("x") for n in names})


class Union:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a
