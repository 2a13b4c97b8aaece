"""Datasets of the panel as definitions over tables, and the benchmark and credit sheets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measures import Measure, aggregate, filtered


@dataclass(frozen=True)
class Dataset:
    """A table with its period, dimensions, measures and the filters it opens with."""

    table: str
    period: str | None
    dimensions: tuple[str, ...]
    measures: tuple[Measure, ...]
    chosen: dict[str, list[str]] = field(default_factory=dict)

    def series(self, df: DataFrame, by: str | None = None, chosen: dict[str, list] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
        """All measures by period and one dimension, under the filters given or else its own."""
        if by is not None and by not in self.dimensions:
            raise ValueError(f"{by} is no dimension of {self.table}")
        keys = [k for k in (by, self.period) if k]
        return aggregate(filtered(df, self.chosen if chosen is None else chosen, self.period, start, end), keys, list(self.measures))


def _sums(names: str) -> tuple[Measure, ...]:
    return tuple(Measure(n, "sum", n) for n in names.split())


def _weighted(names: str, by: str) -> tuple[Measure, ...]:
    return tuple(Measure(n, "weighted", n, by) for n in names.split())


#: The panel's datasets with their columns.
DATASETS = {
    "kpis_anuais": Dataset(
        "kpis_financeiros", "ano", ("empresa", "escopo"),
        _sums("receita_liquida_brl ebit_brl ebitda_brl lucro_liquido_brl ativo_total_brl patrimonio_liquido_brl divida_bruta_brl divida_liquida_brl capex_brl investimento_total_brl")
        + (
            Measure("margem_ebit_pct", "ratio", "ebit_brl", "receita_liquida_brl", 100.0),
            Measure("margem_ebitda_pct", "ratio", "ebitda_brl", "receita_liquida_brl", 100.0),
            Measure("margem_liquida_pct", "ratio", "lucro_liquido_brl", "receita_liquida_brl", 100.0),
            Measure("divida_liquida_ebitda", "ratio", "divida_liquida_brl", "ebitda_brl"),
            Measure("cobertura_juros_ebitda", "ratio", "ebitda_brl", "despesas_financeiras_brl", absolute=True),
            Measure("roe_pct", "ratio", "lucro_liquido_brl", "patrimonio_liquido_brl", 100.0),
        ),
        {"escopo": ["consolidado"]},
    ),
    "kpis_trimestrais": Dataset(
        "kpis_trimestrais", "periodo", ("empresa", "escopo"),
        _sums("receita_liquida_trimestre_brl ebit_trimestre_brl lucro_trimestre_brl receita_liquida_12m_brl ebitda_12m_brl lucro_12m_brl divida_liquida_brl")
        + (Measure("divida_liquida_ebitda_12m", "ratio", "divida_liquida_brl", "ebitda_12m_brl"),),
        {"escopo": ["consolidado"]},
    ),
    "dec_fec": Dataset(
        "dec_fec_distribuidora_anual", "ano", ("distribuidora",),
        _weighted("dec_horas dec_limite_medio_ponderado_horas fec_interrupcoes fec_limite_medio_ponderado", "consumidores_medios") + _sums("consumidores_medios"),
    ),
    "cmo": Dataset(
        "ons_cmo_mensal", "mes", ("subsistema",),
        _weighted("cmo_medio_brl_mwh", "intervalos") + (Measure("cmo_minimo_brl_mwh", "min", "cmo_minimo_brl_mwh"), Measure("cmo_maximo_brl_mwh", "max", "cmo_maximo_brl_mwh")),
    ),
    "ear": Dataset("ons_ear_diario", "data", ("subsistema",), (Measure("ear_verificada_pct", "ratio", "ear_verificada_mwmes", "ear_maxima_mwmes", 100.0), *_sums("ear_verificada_mwmes ear_maxima_mwmes"))),
    "curtailment": Dataset(
        "ons_curtailment_mensal", "mes", ("fonte", "subsistema", "uf", "agente_operador", "usina"),
        (*_sums("energia_cortada_mwh geracao_mwh referencia_mwh"), Measure("corte_pct", "ratio", "energia_cortada_mwh", "referencia_mwh", 100.0)),
    ),
    "curtailment_dono": Dataset(
        "curtailment_por_dono_mensal", "mes", ("proprietario", "fonte"),
        (*_sums("energia_cortada_mwh_estimada referencia_mwh_estimada"), Measure("corte_pct", "ratio", "energia_cortada_mwh_estimada", "referencia_mwh_estimada", 100.0)),
    ),
    "capacidade": Dataset("capacidade_por_proprietario", None, ("origem", "tipo_geracao", "fase", "proprietario"), _sums("potencia_mw usinas"), {"fase": ["Operação"]}),
    "usinas": Dataset("usinas", None, ("origem", "tipo_geracao", "fase", "uf"), _sums("potencia_fiscalizada_mw usinas garantia_fisica_mwmed"), {"fase": ["Operação"]}),
    "leiloes": Dataset(
        "leiloes_geracao", "ano", ("fonte_energia", "tipo_leilao", "tipo_geracao", "uf", "vencedor"),
        _sums("potencia_mw energia_vendida_mwmed garantia_fisica_mwmed investimento_previsto_brl") + _weighted("preco_leilao_brl_mwh preco_teto_brl_mwh desagio_pct", "energia_vendida_mwmed"),
    ),
    "pdd": Dataset(
        "pdd_investimentos", "ano", ("distribuidora", "uf", "regiao", "tipo_obra", "classe_obra"),
        (*_sums("realizado_brl planejado_brl"), Measure("execucao_pct", "ratio", "realizado_brl", "planejado_brl", 100.0)),
    ),
    "bndes": Dataset(
        "bndes_operacoes", "ano", ("subsetor_bndes", "uf", "produto", "porte", "situacao", "cliente"),
        _sums("valor_contratado_brl valor_desembolsado_brl") + _weighted("juros_pct_aa", "valor_contratado_brl"),
    ),
    "debentures": Dataset("debentures_incentivadas", "ano", ("setor", "indexador", "artigo", "emissora"), _sums("valor_brl") + _weighted("taxa_ou_spread_pct", "valor_brl"), {"setor": ["Energia Elétrica"]}),
}


def benchmark_sheet(df: DataFrame, ident: str, size_class: str, value: str = "value", limit: str = "limit") -> DataFrame:
    """Per id: mean value over limit, sets beyond their limit, and its place in the size class.

    A null or zero limit gives no ratio and no violation; ids without any ratio come last.
    """
    ratio = F.col(value) / F.nullif(F.col(limit).cast("double"), F.lit(0.0))
    g = df.groupBy(ident, size_class).agg(F.avg(ratio).alias("ratio"), F.count("*").alias("sets"), F.count_if(ratio > 1).alias("violations"))
    w = Window.partitionBy(size_class)
    return g.withColumn("place", F.rank().over(w.orderBy(F.asc_nulls_last(F.round("ratio", 9)))).cast("long")).withColumn("of", F.count("*").over(w))


def credit_sheet(flows: DataFrame, debts: DataFrame, by: Column) -> DataFrame:
    """Per company: operating cash less investment less dividends, and the debt that falls due up to ``by``."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    f = flows.groupBy("company").agg((z("operating_cash") - z("investment") - z("dividends")).alias("free_cash"))
    d = debts.groupBy("company").agg(z("amount").alias("debt"), F.coalesce(F.sum(F.when(F.col("due") <= by, F.col("amount"))), F.lit(0.0)).alias("due_debt"))
    return f.join(d, "company", "full")
