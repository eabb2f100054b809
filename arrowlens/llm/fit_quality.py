"""python -m arrowlens.llm.fit_quality FOLDER: fits the rule list on the folder's documents and writes it."""

import json
import sys

from arrowlens.llm import quality
from arrowlens.runtime import session
from arrowlens.sources.tables import table

if __name__ == "__main__":
    spark = session(master="local[8]", partitions=8)
    fitted, figures = quality.fit(table(spark, sys.argv[1], "documents"), table(spark, sys.argv[1], "common_word"))
    with open(quality.RULES, "w") as f:
        json.dump(fitted, f, indent=1)
    print(json.dumps(fitted), "held-out precision and recall", figures)
