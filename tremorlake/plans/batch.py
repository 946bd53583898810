"""The batch run from landed features to the processed table, rollups and serving table."""

from ..operators import serving
from ..operators.cleansing import batch_audit, process, rejected
from ..schemas import QUAKES
from ..sources.writers import export_rollup, write_quakes
from . import cube


def write_rollups(quakes, cube_path, rollup_path):
    """One scan of the table into the cube, then eight small exports from it."""
    cube.build(quakes).write.mode("overwrite").parquet(cube_path)
    written = quakes.sparkSession.read.parquet(cube_path)
    for name, (build, order) in cube.ROLLUPS.items():
        export_rollup(build(written), f"{rollup_path}/{name}", order)
    return written


def run_batch(spark, features, processed_path, cube_path, rollup_path, serving_path,
              quarantine_path=None, audit_path=None, broken=None):
    """Process, write, and derive everything else from the written table.

    Reading back cuts the lineage: nothing downstream repeats the JSON parsing or dedup. With
    ``quarantine_path`` what was left out is written too: ``features`` with their reasons, and
    ``documents`` that could not be read at all (``broken``, see ``broken_documents``). With
    ``audit_path`` one row per ingestion.
    """
    write_quakes(process(features), processed_path)
    quakes = spark.read.schema(QUAKES).parquet(processed_path)
    write_rollups(quakes, cube_path, rollup_path)
    serving.write_serving(serving.serving_rows(quakes), serving_path)
    if quarantine_path:
        rejected(features).write.mode("overwrite").json(f"{quarantine_path}/features")
        if broken is not None:
            broken.write.mode("overwrite").json(f"{quarantine_path}/documents")
    if audit_path:
        batch_audit(features).write.mode("overwrite").parquet(audit_path)
    return quakes
