"""Schemas of the stored fact tables and of the landed documents."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "bool": T.BooleanType(),
    "string": T.StringType(),
}


def _struct(spec: str) -> T.StructType:
    """``name:type`` words as a schema; a word without a type is text."""
    fields = []
    for word in spec.split():
        name, _, kind = word.partition(":")
        fields.append(T.StructField(name, _TYPES[kind or "string"]))
    return T.StructType(fields)


# Names, order and types of the stored columns.
TABLES: dict[str, T.StructType] = {
    "workflows": _struct("wid:long name userName startTime:long endTime:long"),
    "components": _struct("cid:long wid:long name engine startTime:long endTime:long"),
    "executedQueries": _struct(
        "qid:long cid:long wid:long queryString engine startTime:long endTime:long"
    ),
    "sparkStages": _struct(
        "qid:long cid:long wid:long stageId:int jobId:int name numTasks:int"
        " submissionTime:long completionTime:long"
    ),
    "hiveStages": _struct(
        "qid:long cid:long wid:long stageId hadoopJobId dependentChildren hiveTaskInfos"
        " startTime:long endTime:long"
    ),
    "queries": _struct("queryId:long queryString"),
    "datasets": _struct("queryId:long tabName isTabSample:bool selBuckets:int totalBuckets:int"),
    "projections": _struct(
        "tabName colName queryId:long agg isArray:bool isDimLookup:bool arrayIndex:int dimTabName"
    ),
    "filters": _struct(
        "tabName colName queryId:long isArray:bool isDimLookup:bool arrayIndex:int dimTabName"
        " operator value"
    ),
    "grouping_attributes": _struct(
        "queryId:long tabName colName isArray:bool isDimLookup:bool arrayIndex:int dimTabName"
    ),
    "join_attributes": _struct(
        "queryId:long tabName colName isArray:bool isDimLookup:bool arrayIndex:int dimTabName"
    ),
    "cluster_metrics": _struct("MetricsName RecordTime:long Value"),
    "scheduler_metrics": _struct("QueueName MetricsName RecordTime:long Value"),
    "applications_metrics": _struct("AppId MetricsName RecordTime:long Value"),
    "nodes_apps_metrics": _struct("nodeAddress appId MetricsName RecordTime:long Value"),
    "nodes_containers_metrics": _struct("nodeAddress containerId MetricsName RecordTime:long Value"),
}

# Field names and types of the polled JSON documents.
CLUSTER = _struct(
    "appsSubmitted:int appsCompleted:int appsPending:int appsRunning:int appsFailed:int"
    " appsKilled:int reservedMB:long availableMB:long allocatedMB:long totalMB:long"
    " reservedVirtualCores:long availableVirtualCores:long allocatedVirtualCores:long"
    " totalVirtualCores:long containersAllocated:int containersReserved:int"
    " containersPending:int totalNodes:int activeNodes:int lostNodes:int unhealthyNodes:int"
    " decommissionedNodes:int rebootedNodes:int"
)
APP = _struct(
    "finishedTime:long amContainerLogs trackingUI state user id clusterId:long finalStatus"
    " amHostHttpAddress progress:float name startedTime:long elapsedTime:long diagnostics"
    " trackingURL queue allocatedMB:int allocatedVCores:int runningContainers:int"
)
RESOURCE = _struct("memory:int vCores:int")
QUEUE = T.StructType(
    _struct(
        "capacity:float usedCapacity:float maxCapacity:float absoluteCapacity:float"
        " absoluteMaxCapacity:float absoluteUsedCapacity:float numApplications:int"
        " usedResources queueName state type numActiveApplications:int"
        " numPendingApplications:int numContainers:int maxApplications:int"
        " maxApplicationsPerUser:int maxActiveApplications:int maxActiveApplicationsPerUser:int"
        " userLimit:int userLimitFactor:float"
    ).fields
    + [T.StructField("resourcesUsed", RESOURCE)]
)
NODE = _struct(
    "rack state id nodeHostName nodeHTTPAddress healthStatus healthReport"
    " lastHealthUpdate:long usedMemoryMB:long availMemoryMB:long usedVirtualCores:long"
    " availableVirtualCores:long numContainers:int"
)
NODE_APP = T.StructType(
    _struct("id user state").fields
    + [T.StructField("containerids", T.ArrayType(T.StringType()))]
)
CONTAINER = _struct(
    "id state nodeId containerLogsLink user exitCode:int diagnostics totalMemoryNeededMB:long"
    " totalVCoresNeeded:long"
)


def names(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields]


def nested(path: str, item: T.DataType, array: bool = True) -> T.StructType:
    """Document schema that holds ``item`` (or an array of it) under a dotted path."""
    leaf: T.DataType = T.ArrayType(item) if array else item
    for name in reversed(path.split(".")):
        leaf = T.StructType([T.StructField(name, leaf)])
    return leaf
