"""The defaults that operators use. Lengths are in points unless a name says otherwise."""

REFERENCE_SCALE = 1.6
# association
BUCKET_PT = 40.0
TEXT_WEIGHT, GEOMETRY_WEIGHT = 0.78, 0.22
MATCH_TEXT, MATCH_GEOMETRY = 0.72, 0.12
CONFLICT_TEXT, CONFLICT_GEOMETRY, NUMERIC_GEOMETRY = 0.5, 0.45, 0.8
# diagnostics
LOW_CONFIDENCE, RELATION_CONFIDENCE, RELATION_AMBIGUITY = 0.5, 0.7, 0.25
STARVED_COUNT, STARVED_COVERAGE = 8, 0.5
# grouping
LINE_TOLERANCE_PT, LINE_RATIO, GROUP_RATIO, ROW_HEIGHT_PT = 5.0, 0.65, 0.55, 5.0
# relations
YEAR_ROW_PT, YEAR_GAP_PT, VALUE_WINDOW_PT, VALUE_MARGIN_PT, ASSIGN_RATIO = 15.0, 50.0, 100.0, 1.25, 0.48
RELATION_BASE, RELATION_BONUS, RELATION_CAP = 0.55, 0.3, 0.85
# ink
INK_CELL_PT, INK_LUMINANCE, INK_FRACTION, READ_DILATE_PT = 6.0, 0.85, 0.08, 2.0
REGION_AREA_PT2, RESIDUE_SIDE_PT, PICTORIAL_MIDTONE = 1600.0, 8.0, 0.3
MERGE_GAP_PT, CLOSE_CELLS, DUPLICATE_OVERLAP, ZOOM = 18.0, 1, 0.5, 4
REGION_MARGIN_PT, TILE_PX = 8.0, 900
# glyph audit
GLYPH_COVERAGE, GLYPH_SUBSTITUTIONS, GLYPH_RATE, WITHHOLD_SHARE, WITHHOLD_LETTERS = 0.6, 2, 0.5, 0.1, 100
# Markdown
MISSING_SHARE, MISSING_WORDS, CELL_WORDS = 0.1, 20, 45
# retrieval
CHUNK_WORDS, BM25_K1, BM25_B = 50, 1.2, 0.75
