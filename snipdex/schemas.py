"""Table schemas as DDL strings."""

# Column names and defaults of the registry tables
WATCH_CONFIG = (
    "struct<filePatterns:array<string>,excludePatterns:array<string>,includeSubdirectories:boolean,"
    "isEnabled:boolean,maxFileSize:bigint,"
    "customFilters:array<struct<name:string,pattern:string,enabled:boolean>>>"
)
HISTORY = "array<struct<date:timestamp,duration:double,filesProcessed:int,snippetsCreated:int>>"
STATISTICS = (
    "struct<indexedSnippets:bigint,totalFiles:bigint,lastIndexingDuration:double,averageFileSize:bigint,"
    f"languageDistribution:map<string,bigint>,indexingHistory:{HISTORY}>"
)
METADATA = (
    "struct<projectType:string,framework:string,team:string,priority:string,tags:array<string>,"
    "customSettings:map<string,string>>"
)

LIBRARIES = (
    "id int, name string, codebase_path string, collection_name string, status string, watch_config string, "
    "statistics string, metadata string, created_at timestamp, updated_at timestamp, last_indexed_at timestamp, "
    "total_files bigint, indexed_snippets bigint, is_active boolean"
)
FILE_INDEX = (
    "id bigint, library_id int, relative_path string, last_indexed_at timestamp, file_size bigint, "
    "file_hash string, snippet_count int, file_metadata string, created_at timestamp, updated_at timestamp"
)
TASKS = (
    "id bigint, task_id string, type string, library_id int, status string, progress int, current_file string, "
    "file_path string, task_config string, task_result string, error_message string, started_at timestamp, "
    "completed_at timestamp, created_at timestamp, updated_at timestamp, priority int"
)
CHANGE_EVENTS = (
    "event_id string, library_id int, file_path string, change_type string, event_time timestamp, status string, "
    "processed_at timestamp, error_message string, retry_count int, last_retry_at timestamp, event_details string"
)
SYSTEM_CONFIG = "key string, value_json string, type string, description string, is_editable boolean"

REGISTRY_TABLES = {
    "libraries": LIBRARIES,
    "file_index": FILE_INDEX,
    "tasks": TASKS,
    "change_events": CHANGE_EVENTS,
    "system_config": SYSTEM_CONFIG,
}
UNIQUE_KEYS = {
    "libraries": [["codebase_path"], ["collection_name"]],
    "file_index": [["library_id", "relative_path"]],
    "tasks": [["task_id"]],
    "change_events": [["event_id"]],
    "system_config": [["key"]],
}

SNIPPET = (
    "path string, language string, namespace string, class_name string, member_name string, kind string, "
    "code string, start_line int, end_line int"
)

CHANGE_RECORD = (
    "change struct<id:string,filePath:string,changeType:string,timestamp:timestamp,library:string,status:string,"
    "retryCount:int,lastRetry:timestamp,errorMessage:string>, savedAt timestamp, version string"
)

LEGACY_CONFIG = (
    "codebaseMappings array<struct<id:string,friendlyName:string,codebasePath:string,collectionName:string,"
    "indexingStatus:string,isMonitoring:boolean,createdAt:timestamp,lastIndexed:timestamp,"
    "watcherConfig:struct<fileExtensions:array<string>,excludeDirectories:array<string>,includeSubdirectories:boolean>,"
    "statistics:struct<totalFiles:int,indexedSnippets:int,lastIndexingDuration:string,lastUpdateTime:timestamp>,"
    "fileIndexDetails:array<struct<filePath:string,lastIndexed:timestamp,fileHash:string,snippetCount:int>>>>, "
    "globalSettings map<string,variant>"
)


def as_struct(columns: str) -> str:
    """A column list as a struct type, for `from_json`."""
    from pyspark.sql import types as T

    return T.StructType.fromDDL(columns).simpleString()
