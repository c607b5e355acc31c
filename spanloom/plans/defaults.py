"""The default rule pack, as plain data.  Replace any part of it in :class:`~.config.TraceConfig`."""

from __future__ import annotations

# Which functions are traced, how their events are labelled, which
# events and services are left out and which strings are parsed further.  They
# have to agree with what the tracer writes.
# A row is a class, a method and a label (none: the event is shown as it is).
EVENT_FORMATS = [
    ("scheduler.DAGSchedulerEventProcessLoop", "doOnReceive", "DAGSchedulerEvent($1.0($1.1))"),
    ("scheduler.TaskSchedulerImpl", "submitTasks", "SubmitTasks($1)"),
    ("scheduler.TaskSchedulerImpl", "taskSetFinished", "TaskSetFinished"),
    ("storage.BlockManager", "getBlockData", "GetBlockData($1)"),
    ("storage.BlockManager", "get", "BlockManagerGet($1)"),
    ("storage.BlockManager", "doPut", "PutBlock($1, $2)"),
    ("storage.BlockManager", "dropFromMemory", "DropFromMemory($1)"),
    ("storage.BlockManager", "removeBlock", "ManagerRemoveBlock($1)"),
    ("storage.BlockManagerMaster", "registerBlockManager", "RegisterBlockManager($1)"),
    ("storage.BlockManagerMaster", "updateBlockInfo", "UpdateBlockInfo($1, $2, $3)"),
    ("storage.BlockManagerMaster", "removeBlock", "MasterRemoveBlock($1)"),
    ("storage.BlockManagerMaster", "removeRdd", "RemoveRdd($1)"),
    ("storage.BlockManagerMaster", "removeShuffle", "RemoveShuffle($1)"),
    ("storage.BlockManagerMaster", "removeBroadcast", "RemoveBroadcast($1)"),
    ("network.netty.NettyBlockTransferService", "fetchBlocks", "FetchBlocks($1:$2 $3, $4)"),
    ("network.netty.NettyBlockTransferService", "uploadBlock", "UploadBlock($1:$2 $3, $4)"),
    ("shuffle.sort.SortShuffleManager", "registerShuffle", "SortShuffleManager.RegisterShuffle($1, $2)"),
    ("shuffle.sort.SortShuffleManager", "unregisterShuffle", "SortShuffleManager.UnregisterShuffle($1)"),
    ("MapOutputTrackerMaster", "registerShuffle", "MapOutputTrackerMaster.RegisterShuffle($1, $2)"),
    ("MapOutputTrackerMaster", "unregisterShuffle", "MapOutputTrackerMaster.UnregisterShuffle($1)"),
]
SPAN_FORMATS = [
    ("rpc.RpcEnv$", "create", "CreateRpcEnv($1)"),
    ("scheduler.cluster.YarnClientSchedulerBackend", "waitForApplication", "WaitOnBackend"),
    ("SparkContext", "createSparkEnv", "CreateSparkEnv"),
    ("SparkContext", "SparkContext", "CreateSparkContext"),
    ("metrics.MetricsSystem", "start", "StartMetricsSystem"),
    ("scheduler.TaskSchedulerImpl", "waitBackendReady", "TaskSchedulerWaitBackend"),
    ("deploy.yarn.ExecutorRunnable", "startContainer", "StartContainer"),
    ("deploy.yarn.ApplicationMaster", "org$apache$spark$deploy$yarn$ApplicationMaster$$waitForSparkDriver", ""),
    ("deploy.yarn.ApplicationMaster", "org$apache$spark$deploy$yarn$ApplicationMaster$$registerAM", ""),
    ("deploy.yarn.Client", "org$apache$spark$deploy$yarn$Client$$distribute$1", ""),
    ("deploy.yarn.Client", "prepareLocalResources", "PrepareLocalResources($1)"),
    ("deploy.yarn.Client", "submitApplication", "SubmitApplication($r)"),
]
NOTEBOOK_SPAN_FORMATS = [
    ("boot.KernelBootstrap", "initialize", "KernelBootstrapInitialize"),
    ("boot.layer.StandardComponentInitialization$class", "initializeComponents", "InitializeComponents"),
    ("plugins.PluginManager", "initialize", "InitializePlugins"),
    ("kernel.interpreter.scala.ScalaInterpreterSpecific$class", "start", "StartScalaInterpreter"),
    ("kernel.interpreter.scala.ScalaInterpreter", "bindVariables", "BindInterpreterVariables"),
]
FILTERS = {
    "3.0 = RPC": {
        "3.3.0 = Heartbeat": False,
        "3.3.0 = HeartbeatResponse": False,
    },
}
REMOVE_SERVICES = [".*driverPropsFetcher"]
CASE_PARSE = {
    "3.0 = Fn": {
        "default": ["3.1"],
        "3.2.1.0 in BeginEvent, CompletionEvent": ["3.2.1.1"],
        "3.1.0 = org.apache.spark.storage.BlockManagerMaster.registerBlockManager": ["3.2.1", "3.2.4"],
        "3.1.0 = org.apache.spark.storage.BlockManager.doPut": ["3.2.2"],
        "3.1.0 = org.apache.spark.storage.BlockManagerMaster.updateBlockInfo": ["3.2.1", "3.2.3"],
    },
    "3.0 = LocalVariable": ["3.1"],
    "3.2.0 = Fn": ["3.2.1"],
    "3.0 = RPC": {
        "3.3.0 = RegisterBlockManager": ["3.3.4"],
        "3.3.0 = RegisterExecutor": ["3.3.2"],
        "3.3.0 = UpdateBlockInfo": ["3.3.3"],
        "3.3.0 = RegisterClusterManager": ["3.3.1"],
        "3.3 ~ ^BlockManagerId\\(": ["3.3"],
        "3.3.1 ~ ^BlockManagerId\\(": ["3.3.1"],
    },
}


def _tracers(kind: str, formats: list[tuple[str, str, str]]) -> list[dict[str, str]]:
    return [{"type": kind, "class": owner, "method": method, "format": label} for owner, method, label in formats]


TARGETS = {
    "org.apache.spark": [
        {"type": "rpc"},
        *_tracers("event", EVENT_FORMATS),
        *_tracers("span", SPAN_FORMATS),
    ],
    "org.apache.toree": _tracers("span", NOTEBOOK_SPAN_FORMATS),
}
