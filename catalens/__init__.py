"""Media catalogue and rendition planning as Spark DataFrame operations.

The names below are the operations a client calls; the modules hold their parts.
"""

from catalens.operators.jobs import job_table, jobs_at
from catalens.operators.lookup import admit, lookup, remove, single_flight, status, versions
from catalens.operators.metadata import metadata
from catalens.operators.people_kernel import predict_people_kernel, train_people_kernel
from catalens.operators.people_model import predict_people, train_people
from catalens.operators.recognition import face_boxes, recognize
from catalens.plans.render import plan
from catalens.session import build_session

__all__ = [
    "admit",
    "build_session",
    "face_boxes",
    "job_table",
    "jobs_at",
    "lookup",
    "metadata",
    "plan",
    "predict_people",
    "predict_people_kernel",
    "recognize",
    "remove",
    "single_flight",
    "status",
    "train_people",
    "train_people_kernel",
    "versions",
]
