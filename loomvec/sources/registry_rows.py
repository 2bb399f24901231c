"""The rows of the model registry, one a line, fields parted by bars; @n stands for a long list of languages."""

LANGUAGES = {
    "@3": "ar de en es fr it ja ko multilingual pt ru zh",
    "@4": "af am ar ay bg bo bs ca cs cy da de dz el en es et eu fa fi fj fr ga gl gn ha haw he hi hr ht hu id ig is it ja kk km ko ky lo lt lv mg mi mk mn ms mt my ne nl no ny om pl pt qu ro ru si sk sl sm sn so sq sr st sv sw tg th ti tk tn to tr tt ug uk uz vi xh yo zh zu",
}

ROWS = """\
minicoil-v1|Sparse|miniCOIL v1|Qdrant/minicoil-v1|Qdrant|2024|bert|distilbert-base|4||66M|4|||||768|512|512|30522|en|text||fp32 fp16 int8|0.46|0.35|Apache-2.0
splade-v3|Sparse|SPLADE v3|naver/splade-v3|Naver Labs|2023|bert|distilbert-base|||66M|30522|||||768|512|512|30522|en|text||fp32 fp16|0.49|0.38|CC-BY-NC-SA-4.0
splade-pp-en-v1|Sparse|SPLADE++ EN v1|prithivida/Splade_PP_en_v1|prithivida|2024|bert|bert-base-uncased|||109M|30522|||||768|512|512|30522|en|text|||0.0|0.3722|apache-2.0
splade-pp-en-v2|Sparse|SPLADE++ EN v2|prithivida/Splade_PP_en_v2|prithivida|2024|bert|bert-base-uncased|||109M|30522|||||768|512|512|30522|en|text|||0.0|0.378|apache-2.0
bge-base-en-v1.5|Dense|BGE-Base-EN-v1.5|BAAI/bge-base-en-v1.5|BAAI|2023|bert|bert-base||mean|109M|768|||||768|512|512|30522|en|text||fp32 fp16 int8|0.53|0.42|MIT
jina-embeddings-v2-small-en|Dense|Jina Embeddings v2 Small EN|jinaai/jina-embeddings-v2-small-en|Jina AI|2023|jina-bert|jina-bert-small-en||mean|33M|512|||||512|8192|8192|30528|en|text||fp32 fp16 int8|0.0|0.0|Apache-2.0
jina-embeddings-v2-base-en|Dense|Jina Embeddings v2 Base EN|jinaai/jina-embeddings-v2-base-en|Jina AI|2023|jina-bert|jina-bert-base-en||mean|137M|768|||||768|8192|8192|30528|en|text||fp32 fp16 int8|0.0|0.0|Apache-2.0
jina-embeddings-v2-base-code|Dense|Jina Embeddings v2 Base Code|jinaai/jina-embeddings-v2-base-code|Jina AI|2023|jina-bert-v2|jina-bert-v2-base-code||mean|161M|768|||||768|8192|8192|61056|en|text||fp32 fp16 int8|0.0|0.0|Apache-2.0
jina-embeddings-v3|Dense|Jina Embeddings v3|jinaai/jina-embeddings-v3|Jina AI|2024|xlm-roberta|jina-xlm-roberta||mean|570M|1024|32|1024|32 64 128 256 512 768 1024|truncate_pooled|1024|8192|8192|250002|@3|text||fp32 fp16 int8|0.0|0.0|Apache-2.0
nomic-embed-v1.5|Dense|Nomic Embed v1.5|nomic-ai/nomic-embed-text-v1.5|Nomic AI|2024|bert|nomic-bert||mean|137M|768|64|768|64 128 256 512 768|truncate_pooled|768|8192|8192|30528|en|text||fp32 fp16 int8|0.54|0.43|Apache-2.0
snowflake-arctic-l|Dense|Snowflake Arctic Embed L|Snowflake/snowflake-arctic-embed-l-v2.0|Snowflake|2024|bert|bert-large||mean|335M|1024|256|1024|256 512 768 1024|truncate_pooled|1024|512|512|30522|en|text||fp32 fp16 int8|0.56|0.45|Apache-2.0
chronos-bolt-small|Timeseries|Chronos Bolt Small|amazon/chronos-bolt-small|Amazon|2024|t5|t5-encoder-decoder|512||48M|512|||||2048|2048|2048|2||timeseries||fp32 fp16 int8|0.0|0.0|Apache-2.0
timesfm-1.0-200m|Timeseries|TimesFM 1.0 200M|google/timesfm-1.0-200m|Google Research|2024|decoder-transformer|patched-decoder|||200M|1280|||||1280|512|512|0||timeseries||fp32 fp16 int8|0.0|0.0|Apache-2.0
bge-m3-multi|Unified|BGE-M3 (Multi-Vector Mode)|BAAI/bge-m3|BAAI|2024|xlm-roberta|xlm-roberta-large|||568M|1024|||||1024|8192|8192|250002|@4|text|1|fp32 fp16 int8|0.55|0.44|MIT
colbert-small|Colbert|ColBERT Small|answerdotai/answerai-colbert-small-v1|Answer.AI|2024|distilbert|distilbert-base|96||33M|96|||||384|512|512|30522|en|text|1|fp32 fp16 int8|0.45|0.32|Apache-2.0
colbert-v2|Colbert|ColBERT v2|colbert-ir/colbertv2.0|Stanford NLP|2022|bert|bert-base|128||110M|128|||||768|512|512|30522|en|text|1|fp32 fp16 int8 binary|0.52|0.39|MIT
colpali-v1.2|VisionLanguage|ColPali v1.2 Merged|vidore/colpali-v1.2-merged|vidore|2024|paligemma|paligemma-3b-mix-448|128||3B|128|||||2048|512|512|257216|multilingual|vision text|1|fp32 fp16 int8|0.0|0.0|gemma
colpali-v1.3-hf|VisionLanguage|ColPali v1.3 HF|vidore/colpali-v1.3-hf|vidore|2024|paligemma|paligemma-3b-mix-448|128||3B|128|||||2048|512|512|257216|multilingual|vision text|1|fp32 fp16 int8|0.0|0.0|gemma
gte-modern-colbert|Colbert|GTE-ModernColBERT v1|lightonai/GTE-ModernColBERT-v1|LightOn AI|2025|modernbert|gte-modernbert-base|||130M|768|||||768|8192|8192|50370|en|text|1|fp32 fp16 int8|0.68|0.75|Apache-2.0
jina-colbert-v2-64|Colbert|Jina ColBERT v2 (64-dim)|jinaai/jina-colbert-v2|Jina AI|2024|jina-bert|jina-bert-v2-base-en|||560M|64|||||768|8192|8192|30528|@4|text|1|fp32 fp16 int8|0.51|0.39|Apache-2.0
jina-colbert-v2-96|Colbert|Jina ColBERT v2 (96-dim)|jinaai/jina-colbert-v2|Jina AI|2024|jina-bert|jina-bert-v2-base-en|||560M|96|||||768|8192|8192|30528|@4|text|1|fp32 fp16 int8|0.53|0.41|Apache-2.0
jina-colbert-v2|Colbert|Jina ColBERT v2|jinaai/jina-colbert-v2|Jina AI|2024|jina-bert|jina-bert-v2-base-en|||560M|768|64|768|64 96 128 256 384 512 768|truncate_output|768|8192|8192|30528|@4|text|1|fp32 fp16 int8|0.54|0.42|Apache-2.0
"""
