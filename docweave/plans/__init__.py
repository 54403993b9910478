"""Compilers of filters, projections and updates, and the frame that pipelines pass on."""
