"""Column types of the 21 tables of the Join Order Benchmark's film database."""

from __future__ import annotations

from weft.types import DataType, struct

# Column names and types of the public data set; # marks an integer column.
_COLUMNS = {
    "aka_name": "#id #person_id name imdb_index name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "aka_title": "#id #movie_id title imdb_index #kind_id #production_year phonetic_code #episode_of_id #season_nr #episode_nr note md5sum",
    "cast_info": "#id #person_id #movie_id #person_role_id note #nr_order #role_id",
    "char_name": "#id name imdb_index #imdb_id name_pcode_nf surname_pcode md5sum",
    "comp_cast_type": "#id kind",
    "company_name": "#id name country_code #imdb_id name_pcode_nf name_pcode_sf md5sum",
    "company_type": "#id kind",
    "complete_cast": "#id #movie_id #subject_id #status_id",
    "info_type": "#id info",
    "keyword": "#id keyword phonetic_code",
    "kind_type": "#id kind",
    "link_type": "#id link",
    "movie_companies": "#id #movie_id #company_id #company_type_id note",
    "movie_info": "#id #movie_id #info_type_id info note",
    "movie_info_idx": "#id #movie_id #info_type_id info note",
    "movie_keyword": "#id #movie_id #keyword_id",
    "movie_link": "#id #movie_id #linked_movie_id #link_type_id",
    "name": "#id name imdb_index #imdb_id gender name_pcode_cf name_pcode_nf surname_pcode md5sum",
    "person_info": "#id #person_id #info_type_id info note",
    "role_type": "#id role",
    "title": "#id title imdb_index #kind_id #production_year #imdb_id phonetic_code #episode_of_id #season_nr #episode_nr series_years md5sum",
}

SCHEMAS = {t: struct(*[(c.lstrip("#"), DataType.INT32 if c[0] == "#" else DataType.VARCHAR) for c in columns.split()]) for t, columns in _COLUMNS.items()}
