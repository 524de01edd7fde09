"""Import of files that arrived since the last run."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallywright.sources.files import escaped, full_path
from tallywright.sources.landing import PREFIX, inventory, require_visible
from tallywright.sources.store import ContributionStore

_LISTING = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)


# Files count as new however old they are; the seen-files log keeps every name, which is its cost.
ANY_AGE = "36500d"


def import_new_files(
    store: ContributionStore,
    landing_root: str,
    *,
    prefix: str = PREFIX,
    checkpoint_location: str | None = None,
    multi_line: bool = False,
) -> StreamingQuery:
    """Starts a run over all files not imported before; it stops by itself when done.

    The stream only carries file names: contents are left out of the listing and
    read by the batch loader, which checks headers and rows. The checkpoint
    remembers the files; it defaults to a folder of the store for this landing root
    and prefix. One run is one batch, loaded in the order of the file stamps, so which
    row of a user and day wins does not depend on when its file arrived within the run.
    """
    spark = store.spark
    root = full_path(spark, landing_root)
    require_visible(spark, root, prefix)
    if checkpoint_location is None:
        name = hashlib.sha256(f"{root}\n{prefix}".encode()).hexdigest()[:24]
        checkpoint_location = f"{store.root}/imports/{name}"

    def load(batch: DataFrame, _batch_id: int) -> None:
        store.load_files(batch, multi_line=multi_line)

    reader = spark.readStream.format("binaryFile").schema(_LISTING).option("recursiveFileLookup", True)
    return (
        inventory(reader.option("maxFileAge", ANY_AGE).load(escaped(root)), root, prefix)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint_location)
        .trigger(availableNow=True)
        .start()
    )
