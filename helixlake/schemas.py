"""Schemas of the record types, as DDL."""

FASTA = "identifier string, sequence string"
FASTQ = "identifier string, optionals map<string,string>, sequence string, quality string"
SAM = "qname string, flag int, rname string, pos int, mapq smallint, cigar string, rnext string, pnext int, tlen int, seq string, qual string, optionals array<struct<tag:string,type:string,data:string>>"
SAM_HEADER = "hd map<string,string>, sq array<map<string,string>>, rg array<map<string,string>>, pg array<map<string,string>>, co array<string>"
PILEUP = "sequence string, position bigint, reference_base string, read_count bigint, read_results array<string>, quality string"
SLOW5 = (
    "read_id string, read_group bigint, digitisation double, offset double, range double, sampling_rate double, len_raw_signal bigint, "
    "raw_signal array<smallint>, channel_number string, median_before double, read_number int, start_mux smallint, start_time bigint, end_reason string"
)
SLOW5_HEADER = "read_group bigint, slow5_version string, attributes map<string,string>, end_reason_map map<string,int>"
LOCATION = "array<struct<node:int,parent:int,start:int,end:int,complement:boolean,join:boolean,five_prime_partial:boolean,three_prime_partial:boolean,gbk_location_string:string>>"
GENBANK = (
    "meta struct<date:string,definition:string,accession:string,version:string,keywords:string,organism:string,source:string,taxonomy:array<string>,origin:string,"
    "locus:struct<name:string,sequence_length:string,molecule_type:string,genbank_division:string,modification_date:string,sequence_coding:string,circular:boolean>,"
    "references:array<struct<authors:string,title:string,journal:string,pub_med:string,remark:string,range:string,consortium:string>>,"
    "base_count:array<struct<base:string,count:bigint>>,other:map<string,string>,name:string,sequence_hash:string,hash_function:string>, "
    "features array<struct<type:string,description:string,attributes:map<string,array<string>>,sequence_hash:string,hash_function:string,sequence:string,location:" + LOCATION + ">>, sequence string"
)
REBASE = "name string, isoschizomers array<string>, recognition_sequence string, methylation_site string, microorganism string, source string, commercial_availability array<string>, references string"
UNIREF = (
    "_id string, _updated string, name string, property array<struct<_type:string,_value:string>>, "
    "representativeMember struct<dbReference:struct<_type:string,_id:string,property:array<struct<_type:string,_value:string>>>,sequence:struct<_VALUE:string,_length:int,_checksum:string>>, "
    "member array<struct<dbReference:struct<_type:string,_id:string,property:array<struct<_type:string,_value:string>>>,sequence:struct<_VALUE:string,_length:int,_checksum:string>>>"
)
_EV = "_VALUE:string,_evidence:string"
_LOC = "location:struct<begin:struct<_position:bigint,_status:string,_evidence:string>,end:struct<_position:bigint,_status:string,_evidence:string>,position:struct<_position:bigint,_status:string,_evidence:string>,_sequence:string>"
_NAMES = f"recommendedName:struct<fullName:struct<{_EV}>,shortName:array<struct<{_EV}>>,ecNumber:array<struct<{_EV}>>>,alternativeName:array<struct<fullName:struct<{_EV}>,shortName:array<struct<{_EV}>>,ecNumber:array<struct<{_EV}>>>>,submittedName:array<struct<fullName:struct<{_EV}>,ecNumber:array<struct<{_EV}>>>>,allergenName:struct<{_EV}>,biotechName:struct<{_EV}>,cdAntigenName:array<struct<{_EV}>>,innName:array<struct<{_EV}>>"
_ORGANISM = "struct<_evidence:string,name:array<struct<_VALUE:string,_type:string>>,dbReference:array<struct<_type:string,_id:string>>,lineage:struct<taxon:array<string>>>"
UNIPROT = (
    "_dataset string, _created date, _modified date, _version int, accession array<string>, name array<string>, "
    f"protein struct<{_NAMES},domain:array<struct<{_NAMES}>>,component:array<struct<{_NAMES}>>>, "
    "gene array<struct<name:array<struct<_VALUE:string,_type:string,_evidence:string>>>>, "
    f"organism {_ORGANISM}, organismHost array<{_ORGANISM}>, geneLocation array<struct<_type:string,_evidence:string,name:array<struct<_VALUE:string,_status:string>>>>, "
    "reference array<struct<_key:string,_evidence:string,citation:struct<_type:string,_date:string,_name:string,_volume:string,_first:string,_last:string,_publisher:string,_city:string,_db:string,_number:string,title:string,"
    "editorList:struct<person:array<struct<_name:string>>,consortium:array<struct<_name:string>>>,authorList:struct<person:array<struct<_name:string>>,consortium:array<struct<_name:string>>>,locator:string,dbReference:array<struct<_type:string,_id:string>>>,scope:array<string>,"
    "source:struct<strain:array<struct<_VALUE:string,_evidence:string>>,plasmid:array<struct<_VALUE:string,_evidence:string>>,transposon:array<struct<_VALUE:string,_evidence:string>>,tissue:array<struct<_VALUE:string,_evidence:string>>>>>, "
    f"comment array<struct<_type:string,_evidence:string,_name:string,_mass:float,_error:string,_method:string,_locationType:string,text:array<struct<{_EV}>>,molecule:string,event:array<struct<_type:string>>,isoform:array<struct<id:array<string>,name:array<struct<{_EV}>>,sequence:struct<_type:string,_ref:string>>>,"
    f"subcellularLocation:array<struct<location:array<struct<{_EV}>>,topology:array<struct<{_EV}>>,orientation:array<struct<{_EV}>>>>,disease:struct<_id:string,name:string,acronym:string,description:string>,{_LOC}>>, "
    "dbReference array<struct<_type:string,_id:string,_evidence:string,molecule:string,property:array<struct<_type:string,_value:string>>>>, proteinExistence struct<_type:string>, keyword array<struct<_VALUE:string,_id:string,_evidence:string>>, "
    f"feature array<struct<_type:string,_id:string,_description:string,_evidence:string,_ref:string,original:string,variation:array<string>,{_LOC}>>, "
    "evidence array<struct<_key:string,_type:string,source:struct<dbReference:struct<_type:string,_id:string>>>>, sequence struct<_VALUE:string,_length:int,_mass:int,_checksum:string,_modified:date,_version:int,_precursor:boolean,_fragment:string>"
)
