"""Search and profile the cells of workbooks and tables with Spark."""

from .operators.blocks import data_ranges
from .operators.cells import (
    cap_columns,
    clean_values,
    in_column,
    in_range,
    in_sheet,
    infer_value_type,
    scan_cells,
    sheet_extents,
    trim_to_used,
    truncate_values,
)
from .operators.compare import compare_sheets
from .operators.fuzzy import fuzzy_cells, fuzzy_headers, similar_texts
from .operators.pivot import cells_to_table, pivot_table
from .operators.postings import (
    build_cell_postings,
    build_content_postings,
    build_header_postings,
    index_size,
    lookup_content,
    token_stats,
)
from .operators.profile import (
    column_samples,
    detect_pivot,
    profile,
    profile_columns,
    profile_sheets,
    profile_workbooks,
    sample_rows,
    summarize_types,
)
from .operators.refs import (
    bounding_ranges,
    cells_in_ranges,
    chunk_ranges,
    convert_refs,
    expand_ranges,
    format_ranges,
    parse_ranges,
    parse_refs,
    range_dims,
    refs_in_ranges,
    shift_refs,
    valid_refs,
    with_cell_refs,
)
from .operators.search import (
    cap_per_sheet,
    describe_workbooks,
    match_cells,
    match_headers,
    match_sheets,
    rank_matches,
    search_cells,
    search_columns,
    search_sheets,
    summarize_matches,
    top_k,
    unresolved,
    with_context,
)
from .operators.states import column_states, column_statistics, merge_states, read_states
from .operators.strata import draw_strata, merge_draws, sample_draws, sample_strata
from .operators.tokens import (
    expand_synonyms,
    extract_entities,
    fold_text,
    list_entities,
    ngrams,
    tokenize,
    tokenize_content,
    tokenize_formulas,
    tokenize_general,
    tokenize_headers,
    tokenize_pivot_fields,
    tokenize_queries,
)
from .plans.routing import classify_queries, route_queries, summarize_routing
from .sources.celltext import cell_lines, parse_cells, parse_lines, read_cell_text, write_cell_text
from .sources.index import changed_files, compact_index, drop_sources, invalidate, load_index, save_index
from .sources.tables import table_lines, table_to_cells
from .sources.workbooks import list_workbooks, open_workbooks, read_workbooks, split_rejects
