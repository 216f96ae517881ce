"""Default metric names the outlier analysis looks at.

Callers may pass any other list; `metrics.discover_keys` finds the names a given log holds.
"""

# Canonical names of the task metrics. The executor run time is left out on purpose: it is
# nearly the task duration itself, so every slow task would explain itself.
TASK_METRIC_KEYS = (
    "executor_deserialize_time",
    "executor_deserialize_cpu_time",
    "executor_cpu_time",
    "peak_execution_memory",
    "result_size",
    "jvm_gc_time",
    "result_serialization_time",
    "memory_bytes_spilled",
    "disk_bytes_spilled",
    "shuffle_read_metrics__remote_blocks_fetched",
    "shuffle_read_metrics__local_blocks_fetched",
    "shuffle_read_metrics__fetch_wait_time",
    "shuffle_read_metrics__remote_bytes_read",
    "shuffle_read_metrics__remote_bytes_read_to_disk",
    "shuffle_read_metrics__local_bytes_read",
    "shuffle_read_metrics__total_records_read",
    "shuffle_read_metrics__remote_requests_duration",
    "shuffle_read_metrics__push_based_shuffle__corrupt_merged_block_chunks",
    "shuffle_read_metrics__push_based_shuffle__merged_fetch_fallback_count",
    "shuffle_read_metrics__push_based_shuffle__merged_remote_blocks_fetched",
    "shuffle_read_metrics__push_based_shuffle__merged_local_blocks_fetched",
    "shuffle_read_metrics__push_based_shuffle__merged_remote_chunks_fetched",
    "shuffle_read_metrics__push_based_shuffle__merged_local_chunks_fetched",
    "shuffle_read_metrics__push_based_shuffle__merged_remote_bytes_read",
    "shuffle_read_metrics__push_based_shuffle__merged_local_bytes_read",
    "shuffle_read_metrics__push_based_shuffle__merged_remote_requests_duration",
    "shuffle_write_metrics__shuffle_bytes_written",
    "shuffle_write_metrics__shuffle_write_time",
    "shuffle_write_metrics__shuffle_records_written",
    "input_metrics__bytes_read",
    "input_metrics__records_read",
    "output_metrics__bytes_written",
    "output_metrics__records_written",
)

# Canonical names of the accumulables.
ACCUMULABLE_KEYS = (
    "auto_batch_size_peak_batch_memory",
    "avg_hash_probe_steps_per_batch",
    "avg_hash_probes_per_row",
    "cache_hits_size",
    "cache_hits_size_uncompressed_",
    "cache_misses_size",
    "cache_misses_size_uncompressed_",
    "cache_rescheduled_misses_size",
    "cache_rescheduled_misses_size_uncompressed_",
    "cache_true_misses_size",
    "cache_true_misses_size_uncompressed_",
    "cache_writes_size",
    "cache_writes_size_uncompressed_",
    "cache_writes_stored_compressed_size",
    "cache_writes_stored_uncompressed_size",
    "cloud_storage_request_count",
    "cloud_storage_request_duration",
    "cloud_storage_request_size",
    "cloud_storage_requests_to_fetch_parquet_footer",
    "cloud_storage_response_size",
    "cloud_storage_retry_count",
    "cloud_storage_retry_duration",
    "columns_with_filters",
    "columns_with_filters_dictionary_encoded",
    "cumulative_time",
    "data_filters_rows_skipped",
    "dictionary_filtering_num_row_groups_eligible",
    "dictionary_filtering_num_row_groups_evaluated",
    "exclusive_time",
    "executor_time_cpu",
    "executor_time_cpu_applying_data_filters",
    "executor_time_cpu_applying_dictionary_filters",
    "executor_time_cpu_auto_batch_size_reset",
    "executor_time_cpu_cache_operations",
    "executor_time_cpu_decoding_columns",
    "executor_time_cpu_decoding_deletion_vectors",
    "executor_time_cpu_decoding_footers",
    "executor_time_cpu_decompressing_pages",
    "executor_time_cpu_distinct_evaluation_total",
    "executor_time_cpu_other",
    "executor_time_io_wait",
    "executor_time_io_wait_aether_metadata",
    "executor_time_io_wait_deletion_vectors",
    "executor_time_io_wait_footers",
    "executor_time_io_wait_full_files_column_data",
    "internal_metrics_executorcputime",
    "internal_metrics_executordeserializecputime",
    "internal_metrics_executordeserializetime",
    "internal_metrics_executorruntime",
    "internal_metrics_input_bytesread",
    "internal_metrics_input_recordsread",
    "internal_metrics_io_requestbytescount",
    "internal_metrics_io_requestcount",
    "internal_metrics_io_requestmsduration",
    "internal_metrics_io_responsebytescount",
    "internal_metrics_io_retrycount",
    "internal_metrics_io_retrydelaymsduration",
    "internal_metrics_jvmgctime",
    "internal_metrics_photonbufferpoolmemorysize",
    "internal_metrics_resultsize",
    "internal_metrics_shuffle_write_byteswritten",
    "internal_metrics_shuffle_write_recordswritten",
    "internal_metrics_trackedoffheapmemorysize",
    "maximum_size_of_1st_varlen_key",
    "minimum_size_of_1st_varlen_key",
    "num_batches_aggregated_in_sparse_mode",
    "num_bytes_spilled_to_disk_due_to_memory_pressure",
    "num_bytes_used_for_var_len_data",
    "num_bytes_written",
    "num_early_close",
    "num_hash_lookups",
    "num_spill_partitions_created",
    "num_uncompressed_bytes_spilled",
    "num_uncompressed_bytes_written",
    "number_of_non_local_rescheduled_scan_tasks",
    "number_of_output_batches",
    "number_of_output_rows",
    "number_of_partitions",
    "peak_memory_usage",
    "peak_reader_threads_utilized",
    "peak_untracked_memory_usage",
    "repeated_reads_estimated_high_size",
    "repeated_reads_estimated_low_size",
    "row_groups_in_files_to_read_total",
    "row_groups_read_actual",
    "rows_scanned",
    "runtime_filter_compressed_output_size_in_bytes",
    "runtime_filter_uncompressed_output_size_in_bytes",
    "sampling_and_range_boundary_calculation_time_in_ns",
    "shuffle_checksum_expression_evaluation_time_in_ns",
    "shuffle_partition_expression_evaluation_time",
    "shuffle_partitioning_type",
    "size_of_data_read_with_io_requests",
    "size_of_row_groups_before_filtering",
    "stage_duration",
    "tasks_total",
    "time_for_merging_spill_files_in_shuffle",
    "time_in_hash_build",
    "time_in_produce",
    "time_spent_compacting_batches",
    "time_spent_in_resizing_hash_table",
    "time_spent_reading_deletion_vectors",
    "time_taken_to_accumulate_rows",
    "time_taken_to_build_runtime_filter",
    "time_taken_to_compress_data",
    "time_taken_to_convert_columns_to_rows",
    "time_taken_to_convert_columns_to_rows_part_of_shuffle_file_write_",
    "time_taken_to_output_runtime_filter",
    "time_taken_to_reserve_memory",
    "time_taken_to_sort_rows_by_partition_id_part_of_shuffle_file_write_",
    "time_taken_waiting_on_file_write_io_part_of_shuffle_file_write_",
    "total_time_spent_producing_shuffle_files",
    "unified_cache_populate_time_for_parquetcolumnchunk",
    "unified_cache_populate_time_for_parquetfooter",
    "unified_cache_populate_time_for_range",
    "unified_cache_read_bytes_for_parquetcolumnchunk",
    "unified_cache_read_bytes_for_parquetfooter",
    "unified_cache_read_bytes_for_range",
    "unified_cache_serve_bytes_for_parquetcolumnchunk",
    "unified_cache_serve_bytes_for_parquetfooter",
    "unified_cache_serve_bytes_for_range",
    "unified_cache_write_bytes_for_parquetcolumnchunk",
    "unified_cache_write_bytes_for_parquetfooter",
    "unified_cache_write_bytes_for_range",
)
