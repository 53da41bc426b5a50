"""No streaming operators are needed: a fitted ``PipelineModel`` from
``featurelens.plans`` can transform a streaming DataFrame as it is."""
