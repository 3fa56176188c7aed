"""Plans made of operators: loading models, evaluating them, quantification."""
